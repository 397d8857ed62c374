"""Watching a folder for new slides with Structured Streaming."""
