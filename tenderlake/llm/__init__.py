"""Training-data operators: deduplication, scoring, mixing, packing and search over a documents table.

Nothing outside this package imports it. Each operator is a function of DataFrames; ``catalog`` names the queries.
"""
