"""Column functions on text, time and numbers."""
