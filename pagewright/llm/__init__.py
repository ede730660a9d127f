"""Operators for preparing language-model training data at corpus scale.

Every operator works on plain DataFrames, keeps its own general interface, and
is applied to whole tables by the thin ``opN_*`` queries in ``queries.py``.
"""
