"""Operators for large text corpora: ten of them, each in a module of its own with its query and SQL."""
