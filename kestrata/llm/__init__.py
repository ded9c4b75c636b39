"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each operator is a function from
DataFrames to DataFrames; ``queries`` holds the thin registered forms.
"""
