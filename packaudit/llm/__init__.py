"""Operators for preparing large training corpora; nothing else in the package imports them."""
