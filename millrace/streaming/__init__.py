"""Change logs and events as streams."""
