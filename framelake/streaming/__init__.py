"""Streaming of the framelake engine."""
