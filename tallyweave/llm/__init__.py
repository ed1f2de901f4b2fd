"""Training-data operators: filters, near-duplicates, packing, models and tokens."""
