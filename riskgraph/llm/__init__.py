"""Operators over text corpora, pages, vectors and media."""
