"""Structured Streaming forms of replay, staging, hashing and mini-batch clustering."""
