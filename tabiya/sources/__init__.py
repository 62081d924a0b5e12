"""Readers. Files come through Spark's own readers, so any file system that Spark reads will do."""
