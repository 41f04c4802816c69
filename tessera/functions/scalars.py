"""Scalar semantics of the rule language as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: numbers within this of each other count as equal.
TOLERANCE = 0.005


def number(c: Column) -> Column:
    """As double; what is no number, and NaN and infinities, is NULL."""
    n = c.try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def micros(c: Column) -> Column:
    """A timestamp as microseconds; session time zone UTC is assumed for local timestamps."""
    return F.unix_micros(c.cast("timestamp"))


def moment(c: Column, kind: str) -> Column:
    """As a local timestamp; text that is none is NULL."""
    return c.try_cast("timestamp_ntz") if kind != "number" else F.lit(None).cast("timestamp_ntz")


def compare(op: str, a: Column, b: Column, kind_a: str, kind_b: str) -> Column:
    """Three-valued comparison: times with times, numbers tolerantly for equality, else text by code point."""
    if "time" in (kind_a, kind_b):
        a, b = moment(a, kind_a), moment(b, kind_b)
    elif kind_a == kind_b == "number":
        a, b = number(a), number(b)
        if op == "=":
            return F.abs(a - b) <= TOLERANCE
        if op == "!=":
            return F.abs(a - b) > TOLERANCE
    else:
        a, b = a.cast("string"), b.cast("string")
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """Double arithmetic; division by zero and overflow are NULL."""
    return number({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op]())


def member(a: Column, options: list[Column], kind: str) -> Column:
    """Exact membership; unknown for NULL."""
    if kind == "number":
        return number(a).isin(*[number(o) for o in options])
    return a.cast("string").isin(*[o.cast("string") for o in options])


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(number(c), digits)


def days_between(a: Column, b: Column) -> Column:
    """a - b in days, with fractions."""
    return (micros(a.try_cast("timestamp_ntz")) - micros(b.try_cast("timestamp_ntz"))) / F.lit(86_400_000_000.0)
