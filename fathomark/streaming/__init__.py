"""Scheduled tasks, asynchronous jobs and incremental reads."""
