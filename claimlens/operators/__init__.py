"""Relational operators over references, registries, fetch logs and queues."""
