"""Data products built from the operators."""
