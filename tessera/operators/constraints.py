"""Column constraints given as small dictionaries, checked in one aggregation per table.

    {"type": "range", "column": c, "min": a, "max": b}   NULL passes
    {"type": "not_null", "column": c}
    {"type": "in_set", "column": c, "values": [...]}      NULL passes
    {"type": "unique", "column": c}                       second and later occurrences fail
    {"type": "regex", "column": c, "pattern": p}          prefix match of the text form, NULL passes
    {"type": "expr", "expr": e}                           SQL condition; NULL fails
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken(c: dict, order: list[str]) -> Column:
    """Whether a row breaks the constraint; never NULL. ``order`` decides which occurrence is the first."""
    kind = c["type"]
    if kind == "expr":
        return ~F.coalesce(F.expr(c["expr"]), F.lit(False))
    col = F.col(f"`{c['column']}`")
    if kind == "range":
        low = col < F.lit(c["min"]) if c.get("min") is not None else F.lit(False)
        high = col > F.lit(c["max"]) if c.get("max") is not None else F.lit(False)
        return F.coalesce(low | high, F.lit(False))
    if kind == "not_null":
        return col.isNull()
    if kind == "in_set":
        return F.coalesce(~col.isin(*c["values"]), F.lit(False))
    if kind == "unique":
        # nulls are never repeats: a hash beside them keeps them from meeting in one task
        apart = F.when(col.isNull(), F.xxhash64(*[F.col(f"`{o}`") for o in order]))
        place = F.row_number().over(Window.partitionBy(col, apart).orderBy(*[F.col(f"`{o}`") for o in order]))
        return F.when(col.isNull(), F.lit(False)).otherwise(place > 1)
    if kind == "regex":
        return F.coalesce(~col.cast("string").rlike(f"^(?:{c['pattern']})"), F.lit(False))
    raise ValueError(f"unknown constraint {kind}")


def flagged(df: DataFrame, constraints: list[dict], order: list[str] | None = None) -> DataFrame:
    """``df`` with a boolean ``__c<i>`` for each constraint."""
    order = order or df.columns
    return df.select("*", *[broken(c, order).alias(f"__c{i}") for i, c in enumerate(constraints)])


def label(c: dict) -> str:
    return f"{c['type']}:{c.get('column', c.get('expr'))}"


def report(df: DataFrame, constraints: list[dict], order: list[str] | None = None) -> DataFrame:
    """One row per constraint (constraint, violations) and one for any of them, with the share of clean rows."""
    marks = [F.col(f"__c{i}") for i in range(len(constraints))]
    any_of = reduce(lambda a, b: a | b, marks)
    counts = flagged(df, constraints, order).agg(F.count(F.lit(1)).alias("n"), F.count_if(any_of).alias("bad"), *[F.count_if(m).alias(f"v{i}") for i, m in enumerate(marks)])
    rows = [F.struct(F.lit(label(c)).alias("constraint"), F.col(f"v{i}").alias("violations"), F.col("n").alias("rows")) for i, c in enumerate(constraints)]
    rows.append(F.struct(F.lit("any").alias("constraint"), F.col("bad").alias("violations"), F.col("n").alias("rows")))
    out = counts.select(F.inline(F.array(*rows)))
    return out.withColumn("pass_pct", F.when(F.col("rows") > 0, F.round(100 * (1 - F.col("violations") / F.col("rows")), 4)))


def examples(df: DataFrame, constraints: list[dict], order: list[str] | None = None, k: int = 5) -> DataFrame:
    """The first ``k`` rows, by ``order``, that break any constraint."""
    order = order or df.columns
    any_of = reduce(lambda a, b: a | b, [F.col(f"__c{i}") for i in range(len(constraints))])
    return flagged(df, constraints, order).where(any_of).orderBy(*[F.col(f"`{o}`") for o in order]).limit(k).select(*df.columns)
