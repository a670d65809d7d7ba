"""Operators for preparing training text. Nothing outside this subpackage imports it.

Each module has one operator with its own general interface; ``queries`` derives the
digest columns of the registered queries from them.
"""
