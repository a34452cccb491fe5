"""Operators of the microstructure engine over sample tables."""
