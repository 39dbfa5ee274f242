"""Bindings, skew-safe scans and the registered query plans."""
