"""Incremental versions of jobs on Structured Streaming."""
