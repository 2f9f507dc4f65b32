"""Readers, writers and the projection of the sample tables."""
