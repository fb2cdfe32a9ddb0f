"""Operators of the run analytics engine."""
