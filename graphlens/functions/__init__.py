"""Column functions and constant tables."""
