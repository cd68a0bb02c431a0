"""cairnset sources."""
