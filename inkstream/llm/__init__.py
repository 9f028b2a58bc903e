"""Training-data operators: deduplication, tokenisation, archives, scoring, mixing and media.

Nothing else in the library imports this subpackage.
"""
