"""Corpus-preparation operators for training data; nothing else in the package imports this one."""
