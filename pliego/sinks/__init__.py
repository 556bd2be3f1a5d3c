"""Sinks: document store, catalog, responses, dead letters."""
