"""Restartable labelling runs on Structured Streaming."""
