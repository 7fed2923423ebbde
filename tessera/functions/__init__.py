"""Column functions: exact numbers, identifiers, contexts and text rules."""
