"""Operators for training-data pipelines over text and duplicate groups.

Nothing outside this package imports it; ``queries`` holds its query functions
and SQL.
"""
