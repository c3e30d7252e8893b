"""Queries: algebra, SPARQL parser, compiler to DataFrames."""
