"""Training-data operators: sharding, tokenising, scanning, deduplication, packing and language ID."""
