"""plans of the replication engine."""
