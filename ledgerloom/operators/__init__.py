"""Operators on ledgers, layouts and vectors."""
