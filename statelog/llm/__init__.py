"""Training-data operators: deduplication, scoring, scanning, mixing and search.

Nothing outside this subpackage imports it; ``catalog`` holds its queries.
"""
