"""Operators for large text corpora (deduplication, quality, mixing, decontamination, ...).

Nothing else in the library imports this subpackage.
"""
