"""Column functions on sequences and color sets."""
