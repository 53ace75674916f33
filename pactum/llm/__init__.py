"""Operators for building language-model training data. Nothing else in pactum imports this package."""
