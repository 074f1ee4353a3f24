"""Operators for large training-data pipelines: search, scoring, filtering, mixing, counting, joins and output.

Nothing outside this subpackage imports it.
"""
