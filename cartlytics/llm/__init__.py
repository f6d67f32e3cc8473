"""Operators of a training-data pipeline: scoring, deduplication, decontamination,
fingerprints, mixing, chat formatting, token counts, sharding, licences, sampling.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
