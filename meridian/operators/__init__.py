"""Relational operators with temporal semantics."""
