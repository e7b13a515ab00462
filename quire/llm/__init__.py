"""Operators of a training-data pipeline and the queries that apply them.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
