"""Operators for large training-text corpora.

Nothing outside this folder imports from it; ``registry`` lists its queries.
"""
