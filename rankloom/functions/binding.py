"""Evaluate a shared sub-expression once inside a larger column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body reads it.
    Branches of a CASE are outside common-subexpression elimination, so long rule lists would
    otherwise repeat the same regular expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)
