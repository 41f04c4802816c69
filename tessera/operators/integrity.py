"""Key and foreign-key faults of a dataset, and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import ForeignKey, Graph

KINDS = ("null_pk", "duplicate_pk", "null_fk", "partial_null_fk", "orphan_fk")


def _any_null(cols: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in cols])


def _all_null(cols: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in cols])


def key_faults(table: str, df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """null_pk (any part null) and duplicate_pk (second and later rows of a whole key).

    Grouping by the key counts repeats with a partial aggregation; no row order is needed.
    """
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    sums = groups.agg(F.coalesce(F.sum(F.when(_any_null(key), F.col("__n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(~_any_null(key), F.col("__n") - 1)), F.lit(0)).alias("b"))
    name = F.lit(f"{table}({','.join(key)})")
    return sums.select(F.inline(F.array(F.struct(F.lit("null_pk").alias("kind"), name.alias("on"), F.col("a").alias("count")), F.struct(F.lit("duplicate_pk").alias("kind"), name.alias("on"), F.col("b").alias("count")))))


def orphans(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Rows of ``child`` with a whole key that ``parent`` has not."""
    known = parent.select(*[F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(key.parent_columns)]).distinct()
    on = [F.col(f"`{c}`") == F.col(f"__p{i}") for i, c in enumerate(key.columns)]
    return child.where(~_any_null(key.columns)).join(known, on, "left_anti")


def reference_faults(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """null_fk (where nulls are not allowed), partial_null_fk (of composite keys) and orphan_fk."""
    name = F.lit(key.name).alias("on")
    nulls = child.agg(F.count_if(_all_null(key.columns)).alias("a"), F.count_if(_any_null(key.columns) & ~_all_null(key.columns)).alias("p"))
    null_count = F.lit(0).cast("long") if key.nullable else F.col("a")
    rows = nulls.select(F.inline(F.array(F.struct(F.lit("null_fk").alias("kind"), name, null_count.alias("count")), F.struct(F.lit("partial_null_fk").alias("kind"), name, F.col("p").alias("count")))))
    lost = orphans(child, parent, key).agg(F.count(F.lit(1)).alias("count")).select(F.lit("orphan_fk").alias("kind"), name, "count")
    return rows.unionByName(lost)


def report(tables: dict[str, DataFrame], graph: Graph) -> DataFrame:
    """kind, on, count for every key and foreign key of the graph."""
    parts = [key_faults(t.name, tables[t.name], t.key) for t in graph.tables.values() if t.key and t.name in tables]
    parts += [reference_faults(tables[k.child], tables[k.parent], k) for k in graph.keys if k.child in tables and k.parent in tables]
    return reduce(DataFrame.unionByName, parts)


def examples(tables: dict[str, DataFrame], key: ForeignKey, k: int = 5) -> DataFrame:
    """The first ``k`` orphan rows, by all columns of the child."""
    lost = orphans(tables[key.child], tables[key.parent], key)
    return lost.orderBy(*[F.col(f"`{c}`") for c in lost.columns]).limit(k)
