"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: str | Column) -> Column:
    """Without white space at both ends (of any kind, not blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: str | Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def c_ln_c(c: Column) -> Column:
    """``c ln c``; zero for a zero count."""
    return F.when(c > 0, c * F.ln(c)).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, or zero where ``b`` is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def abbreviated(n: Column) -> Column:
    """1500 as ``1.5K``, 2000000 as ``2M``, 3000000000 as ``3B``."""

    def short(unit: int, letter: str) -> Column:
        x = F.round(n / unit, 1)
        return F.concat(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")), F.lit(letter))

    return F.when(n >= 10**9, short(10**9, "B")).when(n >= 10**6, short(10**6, "M")).when(n >= 10**3, short(10**3, "K")).otherwise(n.cast("string"))


def joined(context: str | Column) -> Column:
    """A context as text, ids joined by ``-``."""
    return F.array_join(F.transform(context, lambda x: x.cast("string")), "-")


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)
