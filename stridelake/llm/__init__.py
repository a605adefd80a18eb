"""Training-data operators: scans, dedup, archives, scoring, tokens, packing."""
