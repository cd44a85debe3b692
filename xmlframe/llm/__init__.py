"""Training-data operators: quality, mixing, tokenizing, near-duplicates, toxicity, language,
lines, media and embeddings. Nothing else in the library imports this subpackage."""
