"""Text formats and the datasets derived from the relational tables."""
