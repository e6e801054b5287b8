"""Structured Streaming forms of the stateful monitors."""
