"""Training-data operators: search, tokens, shards, filters, media, packing, dedup.

Nothing else in the library imports this subpackage.
"""
