"""Operators for large training-text corpora: filters, joins, tokenizers, models, codecs and record files."""
