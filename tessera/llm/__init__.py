"""Operators of a training-data pipeline: dedup, decontamination, packing, audits, classifiers.

Nothing outside this subpackage imports it; ``llm.catalog`` lists its queries.
"""
