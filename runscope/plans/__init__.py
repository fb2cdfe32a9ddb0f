"""Plans of the run analytics engine."""
