"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  `registry.queries()` lists one
query per operator; `registry.oracle_sql()` has the SQL of those that SQL can
express.
"""
