"""Operators for preparing language-model training data; nothing else in loomtrail imports this package."""
