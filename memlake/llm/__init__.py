"""Training-data operators: quality, packing, PII, language, decontamination,
near-duplicates, chat parsing, page extraction, vector search, token files.

Nothing outside this subpackage imports it.
"""
