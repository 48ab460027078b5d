"""Training-data operators: toxicity, packing, deduplication, quality, decontamination, chat formatting."""
