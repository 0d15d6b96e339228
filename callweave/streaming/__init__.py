"""Incremental synchronisation: a file stream drives a batch comparison in each micro-batch."""
