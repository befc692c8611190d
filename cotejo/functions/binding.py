"""Evaluate an expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    Spark repeats an expression for every mention inside a condition; for chains of regular
    expressions that multiplies the work. A one-element array binds the value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
