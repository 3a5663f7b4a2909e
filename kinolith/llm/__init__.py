"""Operators for training-data work; nothing else in the library depends on this subpackage."""
