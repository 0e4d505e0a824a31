"""Operators of a training-data pipeline over documents, pages and labels.

One module per operator, ``queries`` registers them. Nothing outside this folder imports it.
"""
