"""Structured Streaming forms of the run trace and the rate limiter."""
