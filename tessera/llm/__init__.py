"""Operators for large training corpora: quality, language, near copies, archives, tokens and packing."""
