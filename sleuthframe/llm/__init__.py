"""Operators of a training-data pipeline: filters, near duplicates, scores, searches and tokenizers for text corpora."""
