"""Column functions and text transforms of the write path."""
