"""Structured Streaming views of runs in progress."""
