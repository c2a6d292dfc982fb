"""Replication, reconciliation and transfer analytics as Spark DataFrame operators."""
