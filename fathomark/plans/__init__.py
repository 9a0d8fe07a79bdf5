"""Conditions, filters and their compilation to one Column."""
