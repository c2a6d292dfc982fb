"""functions of the replication engine."""
