"""Column functions over messages, paths, diffs and rubric values."""
