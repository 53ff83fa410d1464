"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it; `queries.py` holds the registered
queries and `oracle.py` their SQL.
"""
