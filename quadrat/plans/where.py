"""Predicates: None, a mapping, an expression, or a list of them, as one boolean column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.errors import MethodError
from quadrat.functions.expr import Expr, Scope


def predicate(where) -> Column | None:
    """A mapping asks for equality, or membership if the value is a collection; lists are joined by and."""
    if where is None:
        return None
    if isinstance(where, Expr):
        return where.build(Scope())
    if isinstance(where, Column):
        return where
    if isinstance(where, Mapping):
        parts = []
        for name, value in where.items():
            c = F.col(name)
            many = isinstance(value, (list, tuple, set, frozenset, range))
            parts.append(c.isin(list(value)) if many else c.isNull() if value is None else c == F.lit(value))
    elif isinstance(where, (list, tuple)):
        parts = [predicate(w) for w in where]
    else:
        raise MethodError("where must be None, a mapping, an expression or a list of expressions", param="where")
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def missing(c: Column, dtype: str) -> Column:
    """Null, and for floats NaN and the infinities."""
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return c.isNull()
