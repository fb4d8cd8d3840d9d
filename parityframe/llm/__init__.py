"""Operators for large training corpora: cleaning, deduplication, scoring and
tokenisation of document tables. Nothing else in the library imports this
subpackage."""
