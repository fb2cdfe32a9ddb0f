"""Sources of the run analytics engine."""
