"""Training-data operators: deduplication, quality, safety, tokenisation and archive conversion over Spark tables.

Nothing else in the library imports this subpackage; it can be deleted on its own.
"""
