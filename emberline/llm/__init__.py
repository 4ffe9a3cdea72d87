"""Training-data operators: decontamination, deduplication, filters, scoring and encoding.

Nothing outside this subpackage imports it.
"""
