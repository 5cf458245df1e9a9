"""sources of the retail engine."""
