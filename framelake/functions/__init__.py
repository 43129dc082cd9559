"""Functions of the framelake engine."""
