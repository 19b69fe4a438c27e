"""Operators for large-scale language-model training corpora.

Nothing else in the package imports this subpackage.
"""
