"""Training-data operators: licence scan, n-gram join, language id, toxicity, fingerprints, mixing, quality, packing, URL filters, near-dedup.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
