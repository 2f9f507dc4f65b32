"""Column functions: geometry, label lines, pose, clocks, scores."""
