"""Streaming forms of catalog aggregates: an extension beyond batch work."""
