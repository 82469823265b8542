"""Training-data pipeline operators: tokenise, deduplicate, classify, fingerprint, search, mix, scan, extract, format.

Nothing outside this folder imports it, except the guarded registry in ``__spark_entry__.py``.
"""
