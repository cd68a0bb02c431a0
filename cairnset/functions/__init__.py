"""cairnset functions."""
