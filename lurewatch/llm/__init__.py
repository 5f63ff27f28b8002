"""Training-data operators: quality rules, deduplication, mixing, tokenizing, sharding, archives and filters."""
