"""Operators for preparing training text: cleaning, deduplication, tokens, packing, personal data, HTML."""
