"""Structured Streaming form of the harvest."""
