"""Operators for training-data pipelines: chat formatting, near-duplicate
join, byte-level BPE, fingerprints, HTML extraction, line templates, PII
surrogates, toxicity, quality rules and source mixing.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
driver queries (one ``opN_*`` per operator) and their oracle SQL.
"""
