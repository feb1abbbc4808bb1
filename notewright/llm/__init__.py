"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``QUERIES`` and
``ORACLES`` (see :mod:`notewright.llm.registry`) hold the thin contract queries.
"""
