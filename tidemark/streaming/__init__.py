"""Structured Streaming: the live panel."""
