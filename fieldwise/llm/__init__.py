"""Operators for preparing training corpora: sharding, near-duplicates, token files,
filters, language and quality models, decontamination, fingerprints, scans, BPE."""
