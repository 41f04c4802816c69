"""Statistics of one or two samples as DataFrames.

Order statistics group by value first, so that windows run over distinct values and not raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoints


def cumulative(df: DataFrame, order: str, sums: dict[str, str], buckets: int | None = None, strict: bool = False) -> DataFrame:
    """``df`` with running sums over the whole frame: {new column: summed column}, in ``order``.

    The rows are dealt into ranges of ``order`` at approximate quantiles; a window runs within each
    range, and the ranges' totals, one small row each, are summed beside. No task sees all rows.
    ``strict`` sums only what comes before. ``order`` must be numeric and distinct.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col(order).cast("double")))
    dealt = df.withColumn("__b", bucket)
    run = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{new}") for new, c in sums.items()])
    offsets = totals.select("__b", *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}") for new in sums])
    inside = dealt.select("*", *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"__r_{new}") for new, c in sums.items()])
    return inside.join(F.broadcast(offsets), "__b").select(*df.columns, *[(F.col(f"__r_{new}") + F.col(f"__o_{new}")).alias(new) for new in sums])


def even_quantiles(df: DataFrame, column: str, steps: int) -> DataFrame:
    """i, value: the exact linear quantile at i / ``steps``, for i from 0 to ``steps``; no rows without values.

    Values are counted, and of the running counts, which are taken in ranges, the ranks that a quantile
    lies between are picked: no task holds all values.
    """
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c")).first()[0] or 0
    if not n:
        return df.sparkSession.createDataFrame([], "i long, value double")
    if n == 1:
        return counts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("i"), F.col("v").alias("value"))
    # quantile i lies at place i * last / steps, between its floor and its ceiling; a value holds the places
    # from ``before`` to ``before + c - 1``, which gives the quantiles it is the lower or the upper end of
    last = n - 1
    run = cumulative(counts, "v", {"before": "c"}, strict=True)
    places = run.selectExpr(
        "v",
        f"(before * {steps} + {last - 1}) div {last} AS low_first",
        f"((before + c) * {steps} + {last - 1}) div {last} - 1 AS low_last",
        f"CASE WHEN before = 0 THEN 0 ELSE ((before - 1) * {steps}) div {last} + 1 END AS high_first",
        f"((before + c - 1) * {steps}) div {last} AS high_last",
    )

    def ends(side: str) -> DataFrame:
        first, final = F.col(f"{side}_first").cast("long"), F.least(F.col(f"{side}_last"), F.lit(steps)).cast("long")
        return places.where(first <= final).select(F.explode(F.sequence(first, final)).alias("i"), F.lit(side).alias("side"), "v")

    both = ends("low").unionByName(ends("high")).groupBy("i").agg(F.max(F.when(F.col("side") == "low", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "high", F.col("v"))).alias("b"))
    part = F.pmod(F.col("i") * F.lit(last), F.lit(steps)) / F.lit(float(steps))
    return both.select("i", F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("value"))


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """i, v, c: how often column number i has the double v, for all columns in one pass; nulls are left out."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), e.cast("double").alias("v")) for i, e in enumerate(columns.values())])
    return df.select(F.explode(cells).alias("s")).select("s.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))


def running_counts(counts: DataFrame) -> DataFrame:
    """``counts`` (i, v, c, others) with ``before``, the counts of smaller values of the same column, and ``n``, the column's total.

    All columns are ranged together by (i, v); a window runs within each range, and the ranges' totals, one row
    for each range and column, are summed beside. The ranges are drawn from a sample, so they are written once.
    """
    spark = counts.sparkSession
    checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, "i", "v").withColumn("__b", F.spark_partition_id()).checkpoint()
    run = Window.partitionBy("__b", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__b", "i").agg(F.sum("c").alias("__t"))
    column = Window.partitionBy("i")
    before = column.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", "i", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"), F.sum("__t").over(column).alias("n"))
    inside = dealt.withColumn("__r", F.coalesce(F.sum("c").over(run), F.lit(0)))
    return inside.join(F.broadcast(offsets), ["__b", "i"]).select(*counts.columns, (F.col("__r") + F.col("__o")).alias("before"), "n")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written once, with the place of each row in ``order`` from 0; rows are ranged, and no task sees all of them."""
    spark = df.sparkSession
    checkpoints(spark)
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__b", F.spark_partition_id()).checkpoint()
    offsets = dealt.groupBy("__b").agg(F.count(F.lit(1)).alias("__c")).select("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inside = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return inside.join(F.broadcast(offsets), "__b").select(*df.columns, (F.col("__r") + F.col("__o") - 1).cast("long").alias(name))


#: Most rows of a table of values that are broadcast.
BROADCAST = 200_000


def looked_up(values: DataFrame, table: DataFrame, new: str, prefix: str) -> DataFrame:
    """``values`` (v0, v1, ...) with each value replaced by ``table``'s (i, v, ``new``): columns ``prefix`` 0, 1, ...; one join for all, by row.

    ``table`` is written already: it is counted, and broadcast where it is small.
    """
    n = len(values.columns)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in range(n)])
    # rows get their numbers before they are parted into cells
    melted = values.withColumn("__row", F.monotonically_increasing_id()).select("__row", F.explode(cells).alias("s")).select("__row", "s.*")
    met = melted.join(F.broadcast(table) if table.count() < BROADCAST else table, ["i", "v"], "left")
    return met.groupBy("__row").agg(*[F.max(F.when(F.col("i") == i, F.col(new))).alias(f"{prefix}{i}") for i in range(n)]).drop("__row")


def quantile_table(df: DataFrame, columns: dict[str, Column], steps: int) -> DataFrame:
    """i, q, value: the exact linear quantile at q / ``steps`` of column number i, for all columns in one pass."""
    run = running_counts(value_counts(df, columns))
    # as in ``even_quantiles``: the quantiles of which a value is the lower or the upper end, by its places
    places = run.selectExpr(
        "i", "v", "n", "before", "c",
        f"(before * {steps} + n - 2) div greatest(n - 1, 1) AS low_first",
        f"((before + c) * {steps} + n - 2) div greatest(n - 1, 1) - 1 AS low_last",
        f"CASE WHEN before = 0 THEN 0 ELSE ((before - 1) * {steps}) div greatest(n - 1, 1) + 1 END AS high_first",
        f"((before + c - 1) * {steps}) div greatest(n - 1, 1) AS high_last",
    )

    def ends(side: str) -> DataFrame:
        first = F.when(F.col("n") == 1, 0).otherwise(F.col(f"{side}_first")).cast("long")
        final = F.when(F.col("n") == 1, steps).otherwise(F.least(F.col(f"{side}_last"), F.lit(steps))).cast("long")
        return places.where(first <= final).select("i", "n", F.explode(F.sequence(first, final)).alias("q"), F.lit(side).alias("side"), "v")

    both = ends("low").unionByName(ends("high")).groupBy("i", "n", "q").agg(F.max(F.when(F.col("side") == "low", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "high", F.col("v"))).alias("b"))
    part = F.pmod(F.col("q") * (F.col("n") - 1), F.lit(steps)) / F.lit(float(steps))
    return both.select("i", "q", F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("value"))


def quantile_grids(df: DataFrame, columns: dict[str, Column], points: int) -> dict[str, list[float]]:
    """The grids of several columns on the driver, at most 1000 numbers each; columns without values are left out."""
    found: dict[int, dict[int, float]] = {}
    for r in quantile_table(df, columns, min(points, 1000) - 1).collect():
        found.setdefault(r["i"], {})[r["q"]] = r["value"]
    return {name: [found[i][q] for q in range(len(found[i]))] for i, name in enumerate(columns) if i in found}


def kth_smallest(df: DataFrame, column: str, k: int, few: int = 50_000, cells: int = 4_096) -> tuple[float, int]:
    """(the ``k``-th smallest value of a numeric column, from 1; the number of smaller ones); nulls are left out.

    Each round counts the values in ``cells`` equal parts of their range, with the least and the largest of each, in
    one action, and goes on in the part that holds the value, until ``few`` rows or one value are left; only those are sorted.
    """
    v = F.col(f"`{column}`")
    left = df.where(v.isNotNull()).select(v.alias("v"))
    whole = left.schema["v"].dataType.typeName() in {"byte", "short", "integer", "long"}
    row = left.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    n, low, high, below = row["n"], row["a"], row["b"], 0
    if not 1 <= k <= n:
        raise ValueError(f"there is no value number {k}")
    while low != high:
        if n <= few:
            last = left.orderBy("v").limit(k - below).agg(F.max("v")).first()[0]
            return last, below + left.where(F.col("v") < F.lit(last)).count()
        if whole and high - low < 1 << 62:
            cell = F.floor((F.col("v").cast("long") - F.lit(low)) / F.lit(float((high - low) // cells + 1)))
        else:  # halves do not overflow
            share = (F.col("v").cast("double") / 2 - F.lit(float(low) / 2)) / F.lit(float(high) / 2 - float(low) / 2)
            cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        parts = left.groupBy(cell.cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # ``cells`` rows
        if len(parts) == 1:  # neighbours that doubles cannot tell apart: sorted as they are
            few = n
            continue
        for part in sorted(parts, key=lambda r: r["cell"]):
            if k <= below + part["n"]:
                break
            below += part["n"]
        n, low, high = part["n"], part["a"], part["b"]
        left = left.where(F.col("v").between(F.lit(low), F.lit(high)))
    return low, below


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """i, v, c: how often column number i has the double v, for all columns in one pass; nulls are left out."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), e.cast("double").alias("v")) for i, e in enumerate(columns.values())])
    return df.select(F.explode(cells).alias("s")).select("s.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))


def running_counts(counts: DataFrame) -> DataFrame:
    """``counts`` (i, v, c, others) with ``before``, the counts of smaller values of the same column, and ``n``, the column's total.

    All columns are ranged together by (i, v); a window runs within each range, and the ranges' totals, one row
    for each range and column, are summed beside. The ranges are drawn from a sample, so they are written once.
    """
    spark = counts.sparkSession
    checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, "i", "v").withColumn("__b", F.spark_partition_id()).checkpoint()
    run = Window.partitionBy("__b", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__b", "i").agg(F.sum("c").alias("__t"))
    column = Window.partitionBy("i")
    before = column.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", "i", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"), F.sum("__t").over(column).alias("n"))
    inside = dealt.withColumn("__r", F.coalesce(F.sum("c").over(run), F.lit(0)))
    return inside.join(F.broadcast(offsets), ["__b", "i"]).select(*counts.columns, (F.col("__r") + F.col("__o")).alias("before"), "n")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written once, with the place of each row in ``order`` from 0; rows are ranged, and no task sees all of them."""
    spark = df.sparkSession
    checkpoints(spark)
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__b", F.spark_partition_id()).checkpoint()
    offsets = dealt.groupBy("__b").agg(F.count(F.lit(1)).alias("__c")).select("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inside = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return inside.join(F.broadcast(offsets), "__b").select(*df.columns, (F.col("__r") + F.col("__o") - 1).cast("long").alias(name))


#: Most rows of a table of values that are broadcast.
BROADCAST = 200_000


def looked_up(values: DataFrame, table: DataFrame, new: str, prefix: str) -> DataFrame:
    """``values`` (v0, v1, ...) with each value replaced by ``table``'s (i, v, ``new``): columns ``prefix`` 0, 1, ...; one join a column.

    Rows stay whole, so that nothing is grouped by row again. ``table`` is written already: its columns are counted, and
    the smallest are broadcast, with ``BROADCAST`` rows in all; only the others are shuffled.
    """
    sizes = {r["i"]: r["n"] for r in table.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    small, room = set(), BROADCAST
    for i in sorted(range(len(values.columns)), key=lambda i: sizes.get(i, 0)):
        if (room := room - sizes.get(i, 0)) > 0:
            small.add(i)
    out = values
    for i in sorted(range(len(values.columns)), key=lambda i: i in small):
        mine = table.where(F.col("i") == i).select(F.col("v").alias("__v"), F.col(new).alias(f"{prefix}{i}"))
        out = out.join(F.broadcast(mine) if i in small else mine, F.col(f"v{i}") == F.col("__v"), "left").drop("__v", f"v{i}")
    return out.select(*[f"{prefix}{i}" for i in range(len(values.columns))])


def quantile_table(df: DataFrame, columns: dict[str, Column], steps: int) -> DataFrame:
    """i, q, value: the exact linear quantile at q / ``steps`` of column number i, for all columns in one pass."""
    run = running_counts(value_counts(df, columns))
    # as in ``even_quantiles``: the quantiles of which a value is the lower or the upper end, by its places
    places = run.selectExpr(
        "i", "v", "n", "before", "c",
        f"(before * {steps} + n - 2) div greatest(n - 1, 1) AS low_first",
        f"((before + c) * {steps} + n - 2) div greatest(n - 1, 1) - 1 AS low_last",
        f"CASE WHEN before = 0 THEN 0 ELSE ((before - 1) * {steps}) div greatest(n - 1, 1) + 1 END AS high_first",
        f"((before + c - 1) * {steps}) div greatest(n - 1, 1) AS high_last",
    )

    def ends(side: str) -> DataFrame:
        first = F.when(F.col("n") == 1, 0).otherwise(F.col(f"{side}_first")).cast("long")
        final = F.when(F.col("n") == 1, steps).otherwise(F.least(F.col(f"{side}_last"), F.lit(steps))).cast("long")
        return places.where(first <= final).select("i", "n", F.explode(F.sequence(first, final)).alias("q"), F.lit(side).alias("side"), "v")

    both = ends("low").unionByName(ends("high")).groupBy("i", "n", "q").agg(F.max(F.when(F.col("side") == "low", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "high", F.col("v"))).alias("b"))
    part = F.pmod(F.col("q") * (F.col("n") - 1), F.lit(steps)) / F.lit(float(steps))
    return both.select("i", "q", F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("value"))


def quantile_grids(df: DataFrame, columns: dict[str, Column], points: int) -> dict[str, list[float]]:
    """The grids of several columns on the driver, at most 1000 numbers each; columns without values are left out."""
    found: dict[int, dict[int, float]] = {}
    for r in quantile_table(df, columns, min(points, 1000) - 1).collect():
        found.setdefault(r["i"], {})[r["q"]] = r["value"]
    return {name: [found[i][q] for q in range(len(found[i]))] for i, name in enumerate(columns) if i in found}


def kth_smallest(df: DataFrame, column: str, k: int, few: int = 50_000) -> tuple[float, int]:
    """(the ``k``-th smallest value of a numeric column, from 1; the number of smaller ones); nulls are left out.

    Approximate quantiles narrow the range that holds it until ``few`` rows or one value are left; only
    those are sorted.
    """
    v = F.col(f"`{column}`")
    left = df.where(v.isNotNull()).select(v.alias("v"))
    below = 0
    while True:
        row = left.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
        rank = k - below
        if not 1 <= rank <= row["n"]:
            raise ValueError(f"there is no value number {k}")
        if row["a"] == row["b"]:
            return row["a"], below
        if row["n"] <= few:
            last = left.orderBy("v").limit(rank).agg(F.max("v")).first()[0]
            return last, below + left.where(F.col("v") < F.lit(last)).count()
        share = rank / row["n"]
        low, high = left.approxQuantile("v", [max(0.0, share - 0.01), min(1.0, share + 0.01)], 0.004)
        counts = left.agg(F.count_if(F.col("v") < F.lit(low)).alias("under"), F.count_if(F.col("v") <= F.lit(high)).alias("upto")).first()
        if counts["under"] < rank <= counts["upto"] and (low > row["a"] or high < row["b"]):
            left, below = left.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))), below + counts["under"]
        elif row["n"] > few and low == row["a"] and high == row["b"]:  # a range of very few values: take the middle apart
            at = left.where(F.col("v") == F.lit(row["a"])).count()
            if rank <= at:
                return row["a"], below
            left, below = left.where(F.col("v") > F.lit(row["a"])), below + at
        else:
            raise RuntimeError("the approximate quantiles miss their error bound")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, q1, median, q3, max, mean, std (population) for numeric columns."""
    aggs = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")))
    quarters = quantile_table(df, {c: F.col(f"`{c}`") for c in columns}, 4).where("q between 1 and 3")
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    wide = quarters.groupBy(names.alias("column")).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in enumerate(("q1", "median", "q3"), 1)])
    rows = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    return rows.join(wide, "column", "left").select("column", "n", "min", "q1", "median", "q3", "max", "mean", "std")


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, nulls, rows, rate."""
    cols = columns or df.columns
    made = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"v{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("nulls"), F.col("n").alias("rows")) for i, c in enumerate(cols)])
    return made.select(F.inline(rows)).withColumn("rate", F.try_divide(F.col("nulls"), F.col("rows")))


def quantile_grid(df: DataFrame, column: str, points: int = 101) -> DataFrame:
    """p, value: exact linear quantiles on an even grid of at most 1000 points."""
    steps = min(points, 1000) - 1
    return even_quantiles(df, column, steps).select((F.col("i") / steps).alias("p"), "value")


def quantiles(df: DataFrame, column: str, points: int) -> list[float] | None:
    """The grid on the driver; at most 1000 numbers. None without values."""
    found = {r["i"]: r["value"] for r in even_quantiles(df, column, min(points, 1000) - 1).collect()}
    return [found[i] for i in range(len(found))] or None


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin (from 1), n, share: equal widths from ``low`` to ``high``, ends clipped in, nulls left out."""
    v = F.col(f"`{column}`").cast("double")
    place = F.floor((v - low) / ((high - low) / bins)) + 1
    b = F.greatest(F.lit(1), F.least(F.lit(bins), place)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def frequencies(df: DataFrame, column: str, top: int, least: int = 1, other: str = "other") -> DataFrame:
    """value, n, share: the ``top`` values with ``least`` rows at least, by count and then name; the rest as one."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(top).withColumn("kept", F.lit(True))
    tagged = counts.join(F.broadcast(best.select("value", "kept")), "value", "left")
    named = tagged.groupBy(F.when(F.col("kept"), F.col("value")).otherwise(F.lit(other)).alias("value")).agg(F.sum("n").alias("n"))
    return named.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def _by_value(df: DataFrame, column: str, side: str) -> DataFrame:
    v = F.col(f"`{column}`")
    kind = dict(df.dtypes)[column]
    v = F.unix_micros(v.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else v.cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias(side))


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: statistic (largest gap of the two empirical distributions), n_a, n_b."""
    both = _by_value(a, column, "a").join(_by_value(b, column, "b"), "v", "full").na.fill(0, ["a", "b"])
    run = cumulative(both, "v", {"ca": "a", "cb": "b"})
    total = both.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))
    return run.crossJoin(F.broadcast(total)).agg(F.max(gap).alias("statistic"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def ks_p(statistic: float, n_a: int, n_b: int) -> float:
    """Asymptotic two-sided p-value."""
    if not n_a or not n_b:
        return 1.0
    n = n_a * n_b / (n_a + n_b)
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * statistic
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _shares(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """value, a, b: counts over the union of values."""
    def one(df: DataFrame, side: str) -> DataFrame:
        return df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias(side))

    return one(a, "a").join(one(b, "b"), "value", "full").na.fill(0, ["a", "b"])


def _with_totals(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts and, as one row beside them, their sums: no window over all values."""
    return both, both.agg(F.sum("a").alias("__a"), F.sum("b").alias("__b"))


def tvd(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: half the summed share differences."""
    both, total = _with_totals(_shares(a, b, column))
    d = F.abs(F.try_divide(F.col("a"), F.col("__a")) - F.try_divide(F.col("b"), F.col("__b")))
    return both.crossJoin(F.broadcast(total)).agg((F.sum(d) / 2).alias("tvd"))


def chi_square(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: chi2 of ``b`` against the shares of ``a``, degrees of freedom, largest share gap.

    Values that ``a`` has not are left out, and the expected counts are scaled to the observed total.
    """
    both, total = _with_totals(_shares(a, b, column).where("a > 0"))
    expected = F.try_divide(F.col("a"), F.col("__a")) * F.col("__b")
    gap = F.abs(F.try_divide(F.col("a"), F.col("__a")) - F.try_divide(F.col("b"), F.col("__b")))
    return both.crossJoin(F.broadcast(total)).select(F.try_divide((F.col("b") - expected) ** 2, expected).alias("x"), gap.alias("g")).agg(F.sum("x").alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"), F.max("g").alias("max_gap"))


def chi_square_p(chi2: float, dof: int) -> float:
    """Upper tail of the chi-square distribution, by series or continued fraction of the gamma function."""
    if dof <= 0 or chi2 <= 0:
        return 1.0
    a, x = dof / 2, chi2 / 2
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(2000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def ranked(df: DataFrame, column: str, by: str = "v") -> DataFrame:
    """value -> average rank (ties share the mean of their places), computed over distinct values."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias(by)).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(counts, by, {"before": "n"}, strict=True).select(by, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation of the rows where both are present."""
    both = df.where(F.col(f"`{x}`").isNotNull() & F.col(f"`{y}`").isNotNull()).select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    pairs = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    rx = ranked(both, "x", "x").withColumnRenamed("rank", "rx")
    ry = ranked(both, "y", "y").withColumnRenamed("rank", "ry")
    r = pairs.join(rx, "x").join(ry, "y")
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    cov = F.sum(F.col("n") * F.col("rx") * F.col("ry")) - sx * sy / n
    vx, vy = F.sum(F.col("n") * F.col("rx") ** 2) - sx**2 / n, F.sum(F.col("n") * F.col("ry") ** 2) - sy**2 / n
    return r.agg(F.try_divide(cov, F.sqrt(vx * vy)).alias("rho"))


@dataclass
class Comoments:
    """Of each two columns over the rows where both are present: counts, and sums of the first, of its squares and of the products."""

    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    def spread(self, i: int, j: int) -> float:
        """The squared deviations of column i where j is present; 0 within rounding for one value."""
        n, s, q = (float(x[i, j]) for x in (self.n, self.sums, self.squares))
        found = q - s * s / n if n else 0.0
        return found if found > 1e-12 * q else 0.0

    def correlation(self, i: int, j: int) -> float | None:
        spread = self.spread(i, j) * self.spread(j, i)
        return float(self.products[i, j] - self.sums[i, j] * self.sums[j, i] / self.n[i, j]) / spread**0.5 if spread > 0 else None

    def mean(self, i: int) -> float:
        return float(self.sums[i, i] / self.n[i, i]) if self.n[i, i] else 0.0

    def deviation(self, i: int) -> float:
        return float(self.spread(i, i) / self.n[i, i]) ** 0.5 if self.n[i, i] else 0.0


def comoments(df: DataFrame, columns: list[str]) -> Comoments:
    """``Comoments`` of doubles, summed in arrays; each partition sends a row for each two columns."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                here = ~np.isnan(z)
                z, mark = np.where(here, z, 0.0), here.astype(np.float64)
                total += np.stack([mark.T @ mark, z.T @ mark, (z * z).T @ mark, z.T @ z])
        i, j = (x.ravel() for x in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), *(t.ravel() for t in total))], names=["i", "j", "n", "s", "q", "p"])

    parts = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "i int, j int, n double, s double, q double, p double")
    out = np.zeros((4, k, k))
    for r in parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in "nsqp"]).collect():  # a row for each two columns
        out[:, r["i"], r["j"]] = r["n"], r["s"], r["q"], r["p"]
    return Comoments(*out)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: Pearson correlations of all pairs, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return made.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def eta2(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row: share of the variance of ``value`` between groups; NULL below ten rows or without variance."""
    v = F.col(f"`{value}`").cast("double")
    groups = df.where(F.col(f"`{category}`").isNotNull() & v.isNotNull()).groupBy(F.col(f"`{category}`")).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    between = F.sum(F.col("s") ** 2 / F.col("n")) - s**2 / n
    return groups.agg(F.when(n >= 10, F.try_divide(between, q - s**2 / n)).alias("eta2"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve by rank sums, ties counted half."""
    s = df.where(F.col(f"`{score}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    counts = s.groupBy(F.col(f"`{score}`").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"`{label}`") == 1).alias("p"))
    r = cumulative(counts, "v", {"before": "n"}, strict=True).select("p", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    pos, all_n, rank_sum = F.sum("p"), F.sum("n"), F.sum(F.col("p") * F.col("rank"))
    return r.agg(F.try_divide(rank_sum - pos * (pos + 1) / 2, pos * (all_n - pos)).alias("auc"))


def auc_by_class(df: DataFrame, label: str, classes: list, scores: dict) -> dict:
    """class -> area under the ROC curve of its score against all other classes, by rank sums of all classes in one pass.

    ``label`` is a column of ``df``, ``scores`` the columns of the classes. None for a class that has all rows or none.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), scores[k].cast("double").alias("v"), (F.col(f"`{label}`") == F.lit(k)).alias("y")) for i, k in enumerate(classes)])
    counts = df.where(F.col(f"`{label}`").isNotNull()).select(F.explode(cells).alias("s")).select("s.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"), F.count_if("y").alias("p"))
    run = running_counts(counts)
    rows = run.groupBy("i", "n").agg(F.sum("p").alias("p"), F.sum(F.col("p") * (F.col("before") + (F.col("c") + 1) / 2)).alias("r")).collect()
    found = {r["i"]: (r["r"] - r["p"] * (r["p"] + 1) / 2) / (r["p"] * (r["n"] - r["p"])) if 0 < r["p"] < r["n"] else None for r in rows}
    return {k: found.get(i) for i, k in enumerate(classes)}


def confusion(df: DataFrame, label: str, predicted: str) -> dict[str, float | None]:
    """accuracy and macro_f1 (the plain mean over all classes that occur as label or prediction), from the table of both."""
    rows = df.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{label}`").alias("a"), F.col(f"`{predicted}`").alias("b")).count().collect()  # classes squared
    n = sum(r["count"] for r in rows)
    if not n:
        return {"accuracy": None, "macro_f1": None}
    f1 = []
    for k in {r["a"] for r in rows} | {r["b"] for r in rows}:
        hit, said, real = (sum(r["count"] for r in rows if ok(r)) for ok in (lambda r, k=k: r["a"] == r["b"] == k, lambda r, k=k: r["b"] == k, lambda r, k=k: r["a"] == k))
        f1.append(2 * hit / (said + real))
    return {"accuracy": sum(r["count"] for r in rows if r["a"] == r["b"]) / n, "macro_f1": sum(f1) / len(f1)}


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
