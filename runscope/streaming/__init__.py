"""Streaming of the run analytics engine."""
