"""marlgate.sources: table registry, structured query, writers."""
