"""Operators for large-scale training-data pipelines. Nothing outside this subpackage imports it.

Each module has one operator with a general interface; ``queries`` derives the contracted
``opN_*`` queries from them.
"""
