"""Refresh as a stream."""
