"""Structured Streaming forms of the activity roll-ups."""
