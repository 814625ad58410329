"""Training-data operators: extraction, filters, deduplication, mixing, tokens, archives."""
