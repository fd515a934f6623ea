"""Column functions: text, names, predicates."""
