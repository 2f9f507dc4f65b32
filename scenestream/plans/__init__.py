"""Whole jobs composed from operators: rule sets, evaluation, reports."""
