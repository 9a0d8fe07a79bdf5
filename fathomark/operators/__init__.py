"""Relational operators: search, grouped statistics, ordering, merging."""
