"""Training-data operators: fingerprints, deduplication, tokenization, packing, scoring.

Nothing outside this folder imports it.
"""
