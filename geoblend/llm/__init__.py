"""Operators for large text corpora: deduplication, packing, mixing, classifiers, formatting. Nothing else in the library imports this subpackage."""
