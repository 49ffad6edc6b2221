"""Training-data operators: filters, deduplication, packing, formatting, archives, tokenizing, search.

Nothing outside this subpackage imports it; the queries it registers are in :mod:`keyloom.llm.queries`.
"""
