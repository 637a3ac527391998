"""Operators for preparing language-model training text.

Nothing outside this package imports it; the entry module adds its queries when it
is present.
"""
