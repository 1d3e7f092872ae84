"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator module has
a general function and a thin ``opN_<name>(spark, sf_dir)`` query; ``queries()``
and ``oracle_sql()`` in ``registry`` collect them.
"""
