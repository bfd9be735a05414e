"""Structured Streaming operators and the batch steps they run per micro-batch."""
