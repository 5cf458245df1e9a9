"""plans of the retail engine."""
