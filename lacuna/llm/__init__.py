"""Operators for building training corpora: deduplication, quality, extraction, mixing, packing.

The subpackage is self-contained; nothing else in the library imports it.
"""
