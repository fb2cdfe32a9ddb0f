"""Spark-native analytics over workflow runs: logs, job metadata and events as tables."""
