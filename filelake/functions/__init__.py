"""Column functions: one value in, one value out."""
