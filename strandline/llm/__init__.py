"""Operators for preparing language-model training data.

Nothing else in ``strandline`` imports this subpackage.
"""
