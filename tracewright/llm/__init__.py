"""Operators for preparing training text: deduplication, scoring, tokenizing, packing, filtering."""
