"""Training-data operators: quality, sharding, media, deduplication, tokens and packing.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
