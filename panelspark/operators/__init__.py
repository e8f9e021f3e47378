"""operators of the panel engine."""
