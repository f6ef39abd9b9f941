"""Training-data operators: near-duplicates, scans, tokenizing, packing and quality scores."""
