"""Operators for large-scale text pipelines.

Nothing outside this subpackage imports it; ``fieldlark.llm.queries`` lists
the registered queries.
"""
