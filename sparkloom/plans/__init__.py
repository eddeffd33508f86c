"""Registered queries and their oracles."""
