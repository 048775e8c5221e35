"""Operators for training-data corpora: quality, tokens, languages, copies, mixtures, search."""
