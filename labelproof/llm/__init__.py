"""Operators and queries for building language-model training corpora."""
