"""Corpus operators for training data: search, redaction, filtering, de-duplication, mixing, packing."""
