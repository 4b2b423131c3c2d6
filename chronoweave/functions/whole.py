"""Whole-number division of columns.  ``/`` goes through doubles, which cannot tell nanoseconds of this century apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(x: Column, n: int | Column) -> Column:
    """The largest whole number not above x / n, for n above zero, as a LONG."""
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    return F.call_function("div", x - F.pmod(x, n), n)


def ceil_div(x: Column, n: int | Column) -> Column:
    """The smallest whole number not below x / n, for n above zero, as a LONG."""
    return -floor_div(-x, n)
