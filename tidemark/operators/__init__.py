"""operators of the replication engine."""
