"""DataFrame operators: one DataFrame (or several) in, one out, nothing executed."""
