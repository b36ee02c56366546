"""Operators for training-data pipelines: tokens, packing, scoring, search, extraction and near-duplicates."""
