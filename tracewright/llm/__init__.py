"""Training-data operators: deduplication, filtering, tokenisation and archive reading on Spark."""
