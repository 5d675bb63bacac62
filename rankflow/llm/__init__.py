"""Training-data operators: privacy, deduplication, language, safety and token work on whole corpora."""
