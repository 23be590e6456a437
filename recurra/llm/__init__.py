"""Training-data operators: deduplication, scoring, filtering, formatting, packing, search."""
