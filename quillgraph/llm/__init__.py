"""Operators for large-scale training-data work over chunked corpora.

Nothing outside this sub-package imports it.  ``registry`` holds its queries and their SQL.
"""
