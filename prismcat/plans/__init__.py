"""Whole queries: the batch preparation and the query catalogue."""
