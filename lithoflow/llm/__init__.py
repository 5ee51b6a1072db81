"""Training-data operators: quality, packing, near-duplicates, toxicity, PII, BPE, substring dedup, language, chat, top-k."""
