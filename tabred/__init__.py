"""DataFrame operators for studying and using redundancy in linked tables."""
