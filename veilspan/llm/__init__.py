"""Training-data operators: extraction, quality, tokens, near-duplicates, scoring, mixing and output."""
