"""Operators for preparing training text: quality, tokens, duplicates, extraction, packing, mixing."""
