"""cairnset operators."""
