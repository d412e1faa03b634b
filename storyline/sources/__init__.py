"""Stored tables and the article feed."""
