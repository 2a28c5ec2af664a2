"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface; ``queries`` registers the contract queries built on them.
"""
