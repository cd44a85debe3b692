"""Column functions: character classes, escaping, references, names, encodings."""
