"""Operators of a training-data pipeline: dedup, personal data, secrets,
language, main text, decontamination, shards, tokens, fingerprints.

Nothing else in the library imports this subpackage; it may import general
helpers of the library.
"""
