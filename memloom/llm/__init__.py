"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Every operator is a function of
DataFrames; ``queries`` and ``oracles`` hold the registered queries.
"""
