"""Training-data operators: filtering, deduplication, tokens and packing.

Nothing else in the library imports this subpackage.
"""
