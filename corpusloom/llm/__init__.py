"""Training-data operators: counting, scoring, searching, packing, deduplicating.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``queries`` derives the registered query results.
"""
