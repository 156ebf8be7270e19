"""Operators for large training corpora, their queries and SQL forms.

Nothing outside this folder imports it. ``registry.QUERIES`` and ``registry.ORACLES`` hold one
query per operator and the pipeline.
"""
