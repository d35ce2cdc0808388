"""Training-data operators: near-duplicate search, scans, filters and tokenization.

Nothing outside this subpackage imports it. Each module holds one operator with
its general interface; ``queries`` holds the thin registered queries.
"""
