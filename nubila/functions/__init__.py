"""Column functions and session helpers."""
