"""Operators for large text corpora: fingerprints, secrets, page text, near copies, toxicity, token files, licences,
byte-level BPE, source mixing and nearest neighbours. Nothing outside this package imports it.
"""
