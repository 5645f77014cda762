"""Training-data operators: near-duplicates, suffix dedup, fingerprints, token files, toxicity, BPE, mixing, licences.

Nothing outside this folder imports it.
"""
