"""Batch operators: deduplication, micro-batches, isolation of rejected rows."""
