"""Operators for preparing large text corpora as training data; nothing else in the library imports this subpackage."""
