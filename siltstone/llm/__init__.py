"""Training-data operators: dedup, fingerprints, tokens, mixing, WARC, PII, toxicity."""
