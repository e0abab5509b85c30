"""Readers for corpus tables, source trees, commit logs and diffs."""
