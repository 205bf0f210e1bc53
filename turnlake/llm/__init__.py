"""Training-data operators: language ID, deduplication, quality, PII, mixing, packing, HTML extraction.

Nothing outside this package imports it. Python workers must be able to import
``turnlake`` (PYTHONPATH, ``--py-files`` or an installed wheel).
"""
