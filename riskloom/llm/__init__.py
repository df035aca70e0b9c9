"""Operators of a training-data pipeline: tokens, archives, duplicates, classifiers, packing, neighbours."""
