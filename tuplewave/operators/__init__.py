"""Operators over DataFrames: tuple-pattern scans, joins, time-to-live, solution modifiers."""
