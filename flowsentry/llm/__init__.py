"""Operators of a training-data pipeline: search, classifiers, joins, token files, formatting.

Nothing outside this subpackage imports it.  ``queries`` registers one query per operator.
"""
