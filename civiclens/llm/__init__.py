"""Training-data operators: de-duplication, mixing, formatting, scoring, packing.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their DuckDB oracles.
"""
