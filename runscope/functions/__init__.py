"""Functions of the run analytics engine."""
