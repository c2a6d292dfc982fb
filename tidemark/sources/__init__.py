"""sources of the replication engine."""
