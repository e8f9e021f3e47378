"""sources of the panel engine."""
