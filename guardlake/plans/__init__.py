"""Operators put together: inputs derived from tables, and end-to-end plans."""
