"""Training-data operators: extraction, formatting, mixing, media, tokens, dedup, sharding, quality.

Nothing else in the library imports this subpackage. Operators take and return
DataFrames; `queries.py` derives the registered digests from them.
"""
