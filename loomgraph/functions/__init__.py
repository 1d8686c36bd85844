"""Column functions: text, fuzzy matching, source records, model responses."""
