"""streaming of the replication engine."""
