"""Plans of the framelake engine."""
