"""Training-data operators: sampling, language, sharding, packing, privacy, near copies, contamination, quality, archives, secrets."""
