"""Operators of the framelake engine."""
