"""Scans, sinks, configuration and table definitions."""
