"""Whole plans: records, search and refresh."""
