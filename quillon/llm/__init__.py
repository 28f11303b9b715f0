"""Operations of a training-data pipeline: mixing, deduplication, packing, scans, counts, classifiers, scoring.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
