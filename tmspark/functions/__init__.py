"""Column functions and the few vectorised helpers."""
