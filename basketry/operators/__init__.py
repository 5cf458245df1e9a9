"""operators of the retail engine."""
