"""Training-data operators: deduplication, quality, language models, tokens, mixing, search."""
