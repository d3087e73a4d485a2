"""Training-data operators: deduplication, filtering, scoring, mixing and packing of text at cluster scale."""
