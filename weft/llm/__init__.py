"""Training-data operators: mixing, filtering, sharding, packing, near-duplicates, scoring, token files."""
