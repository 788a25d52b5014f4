"""Query text to columns and predicates."""
