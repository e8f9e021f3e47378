"""Operators for training-data pipelines over a table of documents.

Self-contained: nothing outside this subpackage imports it, and it imports nothing
from the rest of the library.
"""
