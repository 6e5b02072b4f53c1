"""Training-data operators: extraction, filtering, deduplication, mixing, packing and search.

Nothing outside this subpackage imports it. Each operator lives in its own module with a
general interface; ``queries.py`` holds the thin registered queries and their SQL.
"""
