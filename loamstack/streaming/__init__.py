"""Structured Streaming forms of acceptance and of the operation state machine."""
