"""Operators for preparing training text: filters, deduplication, mixing, packing, token counts.

Nothing outside this subpackage imports it, except the guard in ``__spark_entry__.py``.
"""
