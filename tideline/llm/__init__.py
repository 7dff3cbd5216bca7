"""Training-data operators: filtering, deduplication, scoring, mixing and archiving of documents.

Nothing outside this subpackage imports it.
"""
