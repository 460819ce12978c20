"""Training-data operators: tokenising, classifying, deduplicating, mixing, filtering and searching a corpus."""
