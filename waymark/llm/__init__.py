"""Operators for text training data. Nothing outside of this subpackage imports it."""
