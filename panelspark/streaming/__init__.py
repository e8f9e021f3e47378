"""streaming of the panel engine."""
