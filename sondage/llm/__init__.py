"""Training-data operators: near-dedup, packing, classification, search and tokenisation.

Nothing outside this folder imports it; the rest of the library works without it.
"""
