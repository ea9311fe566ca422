"""Operators for preparing training data: filtering, scoring, deduplicating, mixing, packing, searching and encoding.

Nothing else in the library imports this subpackage.
"""
