"""Training-data operators: quality, toxicity, dedup, PII, mixing, search, BPE, HTML and fingerprints.

Nothing else in the library imports this subpackage.
"""
