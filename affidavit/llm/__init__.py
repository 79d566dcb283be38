"""Operators for preparing training text: filters, near-duplicate removal, tokens, mixing.

Nothing outside this subpackage imports it.
"""
