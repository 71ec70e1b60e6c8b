"""Column builders and distribution-safe numeric helpers."""
