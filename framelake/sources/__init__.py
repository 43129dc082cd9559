"""Sources of the framelake engine."""
