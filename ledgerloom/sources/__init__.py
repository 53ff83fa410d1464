"""Readers and writers of statements, ledgers and prototypes."""
