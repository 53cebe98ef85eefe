"""Training-data operators: filtering, deduplication, search, mixing, counting, packing."""
