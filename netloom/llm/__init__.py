"""Operators for large text corpora; nothing else in netloom imports them."""
