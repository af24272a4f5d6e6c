"""Operators for preparing training text: dedup, decontamination, tokens, quality and privacy."""
