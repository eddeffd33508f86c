"""The threshold trigger over a stream of counter events."""
