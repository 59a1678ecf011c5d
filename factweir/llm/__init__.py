"""Operators of a training-data pipeline: filters, classifiers, joins, packing and search."""
