"""Operators for cleaning and measuring training text at scale.

Nothing outside this subpackage imports it. Each ``opN`` operator lives in its
own module with a general interface; ``queries.py`` holds the thin registered
queries that derive the contract columns.
"""
