"""Training-data operators: tokenising, search, deduplication, filtering and scoring.

Nothing outside this folder (bar the guarded import in ``__spark_entry__``) depends on it.
"""
