"""Training-data operators: search, classification, deduplication, tokenizing, sharding and extraction.

Nothing else in the library imports this subpackage.
"""
