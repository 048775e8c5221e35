"""Structured Streaming: replay of logs and keyed state."""
