"""Data contracts: suites of expectations, compiled to one aggregation per table.

An expectation is {"expect": name, "table": t, ...arguments}. A failed or broken expectation is a
row of the result, never an exception. ``mostly`` is the least share of non-null values that must meet
the expectation.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import family

SLACK = 1e-12
#: At most so many unexpected values are listed.
LISTED = 20


@dataclass
class Measure:
    """What an expectation asks of one aggregation: unexpected and total counts, or an observed value."""

    unexpected: Column | None = None
    total: Column | None = None
    observed: Column | None = None
    verdict: Callable[[float | None], bool] | None = None
    fixed: bool | None = None  # decided by metadata alone


class Broken(ValueError):
    """An expectation that cannot be evaluated; becomes a failed row with an error."""


def _has(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise Broken(f"no column {c}")


def _value(df: DataFrame, e: dict, bad: Callable[[Column], Column]) -> Measure:
    _has(df, e["column"])
    c = F.col(f"`{e['column']}`")
    return Measure(F.count_if(c.isNotNull() & F.coalesce(bad(c), F.lit(False))), F.count(c))


def row_count(df, tables, e):
    low, high = e.get("min"), e.get("max")
    return Measure(observed=F.count(F.lit(1)).cast("double"), verdict=lambda v: (low is None or v >= low) and (high is None or v <= high))


def column_exists(df, tables, e):
    return Measure(fixed=e["column"] in df.columns)


def column_set(df, tables, e):
    want, have = set(e["columns"]), set(df.columns)
    return Measure(fixed=want == have if e.get("exact", True) else want <= have)


def not_null(df, tables, e):
    _has(df, e["column"])
    return Measure(F.count_if(F.col(f"`{e['column']}`").isNull()), F.count(F.lit(1)))


def unique(df, tables, e):
    """Every member of a repeated group is unexpected; group sizes are prepared beside the column."""
    _has(df, e["column"])
    c = F.col(f"`{e['column']}`")
    return Measure(F.count_if(c.isNotNull() & (F.col(f"`__rep_{e['column']}`") > 1)), F.count(c))


def between(df, tables, e):
    _has(df, e["column"])
    if family(dict(df.dtypes)[e["column"]]) not in {"int", "float", "datetime"}:
        raise Broken(f"{e['column']} is neither a number nor a time")
    low, high = e.get("min"), e.get("max")

    def bad(c: Column) -> Column:
        out = F.lit(False)
        if low is not None:
            out = out | ((c <= F.lit(low)) if e.get("strict_min") else (c < F.lit(low)))
        if high is not None:
            out = out | ((c >= F.lit(high)) if e.get("strict_max") else (c > F.lit(high)))
        return out

    return _value(df, e, bad)


def in_set(df, tables, e):
    return _value(df, e, lambda c: ~c.isin(*e["values"]))


def matches(df, tables, e):
    try:
        re.compile(e["regex"])
    except re.error as why:
        raise Broken(f"bad pattern: {why}") from why
    return _value(df, e, lambda c: ~c.cast("string").rlike(f"^(?:{e['regex']})$"))


def of_type(df, tables, e):
    _has(df, e["column"])
    have = family(dict(df.dtypes)[e["column"]])
    return Measure(fixed=have == e["type"] or (e["type"] == "float" and have == "int"))


def pair_greater(df, tables, e):
    _has(df, e["a"], e["b"])
    a, b = F.col(f"`{e['a']}`"), F.col(f"`{e['b']}`")
    good = a >= b if e.get("or_equal") else a > b
    both = a.isNotNull() & b.isNotNull()
    return Measure(F.count_if(both & ~good), F.count_if(both))


def in_other_table(df, tables, e):
    return _value(df, e, lambda c: F.col(f"`__in_{e['other']}_{e['other_column']}_{e['column']}`").isNull())


def mean_between(df, tables, e):
    _has(df, e["column"])
    return Measure(observed=F.avg(F.col(f"`{e['column']}`").cast("double")), verdict=lambda v: v is not None and e["min"] <= v <= e["max"])


def proportion_true(df, tables, e):
    _has(df, e["column"])
    return Measure(observed=F.avg((F.col(f"`{e['column']}`").cast("double") == 1).cast("double")), verdict=lambda v: v is not None and e["min"] <= v <= e["max"])


def equals_child_sum(df, tables, e):
    total = F.coalesce(F.col(f"`__sum_{e['child']}_{e['child_value']}`"), F.lit(0.0)) * F.lit(float(e.get("multiplier", 1)))
    return _value(df, e, lambda c: F.abs(c.cast("double") - total) > F.lit(float(e.get("tolerance", 0.01))))


EXPECTATIONS: dict[str, Callable] = {
    "row_count_between": row_count, "column_exists": column_exists, "columns_match_set": column_set, "not_null": not_null, "unique": unique,
    "between": between, "in_set": in_set, "regex": matches, "of_type": of_type, "pair_greater": pair_greater, "in_other_table": in_other_table,
    "mean_between": mean_between, "proportion_true": proportion_true, "equals_child_sum": equals_child_sum,
}


def register(name: str, fn: Callable) -> None:
    """Add an expectation: fn(df, tables, arguments) -> Measure."""
    EXPECTATIONS[name] = fn


def _prepared(df: DataFrame, tables: dict[str, DataFrame], expectations: list[dict]) -> DataFrame:
    """``df`` with what its expectations need from elsewhere: parent keys, child sums and group sizes."""
    for e in expectations:
        if e["expect"] == "in_other_table" and e["other"] in tables and e["column"] in df.columns:
            label = f"__in_{e['other']}_{e['other_column']}_{e['column']}"
            if label not in df.columns:
                keys = tables[e["other"]].select(F.col(f"`{e['other_column']}`").alias(label)).where(F.col(f"`{label}`").isNotNull()).distinct()
                df = df.join(keys, F.col(f"`{e['column']}`") == F.col(f"`{label}`"), "left")
        if e["expect"] == "equals_child_sum" and e["child"] in tables:
            label = f"__sum_{e['child']}_{e['child_value']}"
            if label not in df.columns:
                sums = tables[e["child"]].groupBy(F.col(f"`{e['child_key']}`").alias("__k")).agg(F.sum(F.expr(e["child_value"]).cast("double")).alias(label))
                df = df.join(sums, F.col(f"`{e['key']}`") == F.col("__k"), "left").drop("__k")
        if e["expect"] == "unique" and e["column"] in df.columns:
            c = F.col(f"`{e['column']}`")
            apart = F.when(c.isNull(), F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]))  # nulls need not meet
            df = df.withColumn(f"__rep_{e['column']}", F.count(F.lit(1)).over(Window.partitionBy(c, apart)))
    return df


def run(tables: dict[str, DataFrame], suite: list[dict]) -> list[dict]:
    """One result per expectation, in the suite's order. One action per table."""
    results: list[dict] = [{"expect": e["expect"], "table": e.get("table"), "column": e.get("column"), "success": False, "unexpected": None, "total": None, "observed": None, "error": None} for e in suite]
    for table in dict.fromkeys(e.get("table") for e in suite):
        mine = [i for i, e in enumerate(suite) if e.get("table") == table]
        if table not in tables:
            for i in mine:
                results[i]["error"] = f"no table {table}"
            continue
        df, measures, aggs = tables[table], {}, []
        wide = _prepared(df, tables, [suite[i] for i in mine])
        for i in mine:
            e = suite[i]
            try:
                fn = EXPECTATIONS.get(e["expect"])
                if fn is None:
                    raise Broken(f"unknown expectation {e['expect']}")
                if e["expect"] == "in_other_table" and e["other"] not in tables:
                    raise Broken(f"no table {e['other']}")
                m = fn(df, tables, e)
            except (Broken, KeyError) as why:
                results[i]["error"] = str(why)
                continue
            measures[i] = m
            for tag, column in (("u", m.unexpected), ("t", m.total), ("o", m.observed)):
                if column is not None:
                    aggs.append(column.alias(f"{tag}{i}"))
        row = wide.agg(*aggs).first().asDict() if aggs else {}
        for i, m in measures.items():
            r = results[i]
            if m.fixed is not None:
                r["success"] = m.fixed
            elif m.observed is not None:
                r["observed"] = row[f"o{i}"]
                r["success"] = bool(m.verdict(r["observed"]))
            else:
                r["unexpected"], r["total"] = row[f"u{i}"], row[f"t{i}"]
                share = 1.0 if not r["total"] else 1 - r["unexpected"] / r["total"]
                r["success"] = share + SLACK >= suite[i].get("mostly", 1.0)
    return results


def unexpected_values(df: DataFrame, column: str, bad: Column, k: int = LISTED) -> DataFrame:
    """The first ``k`` values that do not meet a condition, smallest first."""
    return df.where(F.col(f"`{column}`").isNotNull() & bad).select(F.col(f"`{column}`").alias("value")).orderBy("value").limit(k)


def as_frame(spark, results: list[dict]) -> DataFrame:
    """Results as a table."""
    schema = "expect string, table string, column string, success boolean, unexpected long, total long, observed double, error string"
    return spark.createDataFrame([tuple(r.values()) for r in results], schema)


def to_great_expectations(suite: list[dict], name: str) -> dict[str, dict]:
    """The suite in the common exchange form, one object per table."""
    out: dict[str, dict] = {}
    for e in suite:
        args = {k: v for k, v in e.items() if k not in {"expect", "table"}}
        out.setdefault(e["table"], {"expectation_suite_name": f"{name}.{e['table']}", "expectations": []})["expectations"].append({"expectation_type": f"expect_{e['expect']}", "kwargs": args})
    return out


def to_html(results: list[dict]) -> str:
    rows = "".join(f"<tr><td>{'&#10003;' if r['success'] else '&#10007;'}</td>" + "".join(f"<td>{html.escape(str(r[k] if r[k] is not None else ''))}</td>" for k in ("table", "expect", "column", "unexpected", "total", "observed", "error")) + "</tr>" for r in results)
    return f"<table><tr><th></th><th>table</th><th>expectation</th><th>column</th><th>unexpected</th><th>total</th><th>observed</th><th>error</th></tr>{rows}</table>"
