"""Training-data operators: sharding, tokenising, packing, near-duplicates, search, scans, quality and archives."""
