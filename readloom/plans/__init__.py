"""Encoding plans: the scheme and size of each stream of each block."""
