"""Structured Streaming forms of the triggers, captures and feeds."""
