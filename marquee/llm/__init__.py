"""Training-data operators: fingerprints, deduplication, extraction, filters and packing."""
