"""Readers, and the corpus tables taken from the given ones."""
