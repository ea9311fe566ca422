"""Readers of external forms."""
