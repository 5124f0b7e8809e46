"""Readers and writers: driver tables, pair files, caches, result logs."""
