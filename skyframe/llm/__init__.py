"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage; ``queries`` and ``oracles`` hold the
registered queries and their SQL.
"""
