"""Operators for building training corpora, one module each; nothing else in the library imports them."""
