"""Training-data operators: tokenising, deduplication, filtering, formatting and archiving of text corpora."""
