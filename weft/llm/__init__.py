"""Operators for preparing language-model training data at scale; nothing outside this subpackage imports it."""
