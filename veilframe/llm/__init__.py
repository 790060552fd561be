"""Training-data operators: tokenising, extraction, filtering and deduplication.

Nothing else in the package imports this subpackage.
"""
