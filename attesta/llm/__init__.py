"""Operators for building training corpora, one module per operator; nothing else in the library imports them."""
