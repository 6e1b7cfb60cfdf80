"""Query registration."""
