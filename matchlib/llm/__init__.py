"""Training-data operators: tokens, archives, extraction, deduplication and packing.

Nothing else in the library imports this subpackage.
"""
