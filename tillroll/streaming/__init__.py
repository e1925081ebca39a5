"""Structured Streaming form of the raw-to-bronze step."""
