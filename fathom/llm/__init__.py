"""Operators of a training-data pipeline (sharding to byte-pair encoding).

Nothing outside this subpackage imports it; the rest of the library works
without it.
"""
