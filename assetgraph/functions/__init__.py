"""Column functions: text, predicates, canonical forms."""
