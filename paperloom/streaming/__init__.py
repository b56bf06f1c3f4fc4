"""Structured Streaming versions of the operators that keep state."""
