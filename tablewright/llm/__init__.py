"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface. ``queries`` derives the registered queries from
them. Nothing outside this subpackage imports it.
"""
