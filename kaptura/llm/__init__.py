"""Training-data operators: near-dedup, tokenisation, quality, decontamination, PII and more.

Nothing outside this subpackage imports it.
"""
