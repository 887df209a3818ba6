"""Streaming forms of the rate limiter, counts and de-duplication by digest."""
