"""Training-data operators: scoring, scanning, deduplication, encoding, packing and archive writers.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
