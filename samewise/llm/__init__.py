"""Operators for the preparation of language-model training data. Nothing outside this folder imports it."""
