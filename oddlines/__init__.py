"""Batch and streaming Spark jobs that find structurally unusual lines of source code."""
