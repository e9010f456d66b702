"""Training-data operators: text scanning, fingerprinting, deduplication, archives and tokenising."""
