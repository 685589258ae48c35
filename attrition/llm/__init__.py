"""Operators for building large training corpora, one module each.

``load_queries()`` returns the registered queries (Spark builder and, where SQL
can express the operator, DuckDB SQL).  Nothing else in the library imports
this package."""

from attrition.llm.registry import load_queries

__all__ = ["load_queries"]
