"""cairnset streaming."""
