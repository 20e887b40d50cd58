"""Corpus operators for preparing training text at scale."""
