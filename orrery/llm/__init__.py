"""Training-data operators: deduplication, filtering, scoring and mixing of text corpora.

Nothing else in the library imports this subpackage.
"""
