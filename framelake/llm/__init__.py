"""Training-data operators: dedup, decontamination, archives, tokens, shards, filters, quality and toxicity."""
