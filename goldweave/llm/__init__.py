"""Operators that prepare text collections for language-model training.

Nothing else in the library imports this subpackage.
"""
