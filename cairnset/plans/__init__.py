"""cairnset plans."""
