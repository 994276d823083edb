"""Structured Streaming forms of the incremental operators.

Every sink writes one folder per micro-batch and overwrites it when the batch is retried, so a
lost executor or driver never duplicates rows.
"""
