"""Operators that a training-data pipeline needs: text, URL, embedding and media stages.

Nothing else in the library imports this subpackage.
"""
