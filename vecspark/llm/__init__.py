"""Operators that prepare text, pages and media for training language models."""
