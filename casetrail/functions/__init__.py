"""Scalar functions: Python functions that build Columns, and their SQL names."""

from casetrail.functions import measures, paths, sqlfuncs

__all__ = ["measures", "paths", "sqlfuncs"]
