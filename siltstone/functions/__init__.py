"""Column functions and per-document logic."""
