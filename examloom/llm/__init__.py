"""Training-data operators: sharding, dedup, decontamination, tokenisation, filters, archives.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` holds
the thin registered queries and ``sql`` their DuckDB statements.
"""
