"""Training-data operators: quality, near-duplicates, decontamination, tokens, mixing, sharding, scans for secrets and personal data.

Nothing outside this subpackage imports it.
"""
