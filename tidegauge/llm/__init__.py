"""Training-data operators.

Nothing outside this subpackage imports it; ``llm.queries`` holds the queries
and the DuckDB texts that ``__spark_entry__`` registers.
"""
