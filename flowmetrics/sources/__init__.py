"""Readers and writers for the telemetry files."""
