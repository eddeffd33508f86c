"""Shared helpers: parameters, scratch tables, line numbers."""
