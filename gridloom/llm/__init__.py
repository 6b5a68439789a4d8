"""Corpus-preparation operators (token counts, search, dedup, filters, mixing)."""
