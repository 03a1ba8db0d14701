"""Training-data operators: sharding, scoring, counting, deduplication, extraction and filtering of text corpora."""
