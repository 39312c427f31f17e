"""Structured Streaming drivers of the incremental operators."""
