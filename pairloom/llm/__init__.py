"""Training-data operators: language ID, search, deduplication, mixing, quality, token output, URL filters, BPE."""
