"""Operators for preparing training corpora.

Each module holds one operator with a general interface; ``queries`` holds the
thin fixed-contract queries over them. Nothing outside this package imports it.
"""
