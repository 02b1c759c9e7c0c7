"""Training-data operators: deduplication, decontamination, scoring, packing."""
