"""Training-data operators: dedup, quality, sharding, scans, mixing and tokenisation over document tables."""
