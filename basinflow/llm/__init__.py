"""Training-data operators: near-duplicates, search, quality, sharding, packing, personal data, language, BPE, HTML."""
