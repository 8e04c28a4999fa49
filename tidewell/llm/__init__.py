"""Operators for large text corpora: encoding, quality, sharding, search, de-duplication, extraction, secrets.

Nothing outside this folder imports it; ``queries.py`` here registers its queries.
"""
