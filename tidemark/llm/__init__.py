"""Operators for text corpora: token ids, mixtures, subjects. Nothing outside this package imports it."""
