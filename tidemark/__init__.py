"""Spark jobs for local-area signals: change history, stories, listings, weather."""
