"""Operators for text training data: pairs, packing, split overlap, leakage, mixing, languages.

Optional: nothing else in the library imports this subpackage.
"""
