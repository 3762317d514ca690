"""Training-data operators: deduplication, filtering, extraction, formatting, packing."""
