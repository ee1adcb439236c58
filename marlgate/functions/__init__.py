"""marlgate.functions: column helpers."""
