"""What text columns mean: patterns, date formats and semantic types, from one aggregation per table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import family, normal

#: Patterns of values, in the order in which they are tried.
PATTERNS = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "url": r"^https?://\S+$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$",
    "money": r"^-?[$€£¥₹]\s?\d[\d,. ]*$|^\d[\d,. ]*\s?[€£₹]$",
    "phone": r"^\+?[\d\s().-]{7,20}$",
    "json": r"^\{.*\}$",
}
#: Date formats, in the order in which they are tried.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "dd MMM yyyy", "MMM dd, yyyy"]
NAMES = {"email": ("email", "mail"), "phone": ("phone", "mobile", "tel"), "city": ("city", "town"), "country": ("country",), "postal_code": ("zip", "postcode", "postal"), "name": ("name",), "currency": ("currency",), "percent": ("pct", "percent", "rate", "discount"), "money": ("price", "amount", "total", "balance", "cost", "income", "salary")}


def shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, pattern, share of trimmed non-empty values that match; one pass."""
    cols = columns or [c for c, t in df.dtypes if family(t) == "str"]
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(f"`{c}`"))
        v = F.when(v != "", v)
        aggs += [F.avg(v.rlike(p).cast("double")).alias(f"{i}/{n}") for n, p in PATTERNS.items()]
    made = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("pattern"), F.coalesce(F.col(f"`{i}/{n}`"), F.lit(0.0)).alias("share")) for i, c in enumerate(cols) for n in PATTERNS]
    return made.select(F.inline(F.array(*rows)))


def date_format(df: DataFrame, column: str, least: float = 0.9) -> str | None:
    """The first format that ``least`` of the values have; none for columns that are mostly numbers."""
    v = F.trim(F.col(f"`{column}`"))
    v = F.when(v != "", v)
    row = df.agg(F.avg(v.try_cast("double").isNotNull().cast("double")).alias("num"), *[F.avg(F.try_to_timestamp(v, F.lit(f)).isNotNull().cast("double")).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)], F.count(v).alias("n")).first()
    if not row["n"] or (row["num"] or 0) > 0.5:
        return None
    # nulls of try_to_timestamp over null values count as misses; rescale by presence
    total = df.count()
    return next((f for i, f in enumerate(DATE_FORMATS) if (row[f"f{i}"] or 0) * total / row["n"] >= least), None)


#: Columns of about so many values at most are counted together.
FEW_VALUES = 50_000


def distinct_counts(df: DataFrame) -> list[int]:
    """The number of values of each column. Columns of many values are dealt out by value before they are counted, so that no task holds more than its part."""
    if not df.columns:
        return []
    about = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"a{i}") for i, c in enumerate(df.columns)]).first()
    few = [i for i in range(len(df.columns)) if about[f"a{i}"] <= FEW_VALUES]
    row = df.agg(*[F.count_distinct(F.col(f"`{df.columns[i]}`")).alias(f"d{i}") for i in few]).first() if few else {}
    return [row[f"d{i}"] if i in few else df.select(F.col(f"`{c}`").alias("v")).where("v is not null").repartition("v").distinct().count() for i, c in enumerate(df.columns)]


def propose(df: DataFrame, table: str) -> dict:
    """Semantic types and constraints of a table's columns, sealed by a hash."""
    found: dict[str, dict[str, float]] = {}
    for r in shares(df).collect():  # one row per text column and pattern
        found.setdefault(r["column"], {})[r["pattern"]] = r["share"]
    # without distinct counts among them, strings' ends need no sort of the rows
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *[F.min(f"`{c}`").cast("string").alias(f"lo{i}") for i, c in enumerate(df.columns)], *[F.max(f"`{c}`").cast("string").alias(f"hi{i}") for i, c in enumerate(df.columns)]).first().asDict()
    stats |= {f"d{i}": n for i, n in enumerate(distinct_counts(df))}
    columns = []
    for i, (c, t) in enumerate(df.dtypes):
        kind, name = family(t), normal(c)
        semantic = next((p for p, s in found.get(c, {}).items() if s >= 0.9), None)
        fmt = date_format(df, c) if kind == "str" and semantic is None else None
        if fmt:
            semantic = "date"
        if semantic is None:
            semantic = next((s for s, words in NAMES.items() if any(w in name.split("_") or name.endswith(w) for w in words)), None)
        if semantic is None:
            semantic = {"bool": "boolean", "datetime": "timestamp", "int": "integer", "float": "number"}.get(kind, "category" if stats[f"d{i}"] <= 50 else "text")
        rules = []
        if stats["n"] and stats[f"c{i}"] == stats["n"]:
            rules.append({"type": "not_null", "column": c})
            if stats[f"d{i}"] == stats["n"]:
                rules.append({"type": "unique", "column": c})
        if kind in {"int", "float"} and stats[f"lo{i}"] is not None:
            rules.append({"type": "range", "column": c, "min": float(stats[f"lo{i}"]), "max": float(stats[f"hi{i}"])})
        columns.append({"name": c, "family": kind, "semantic": semantic, "format": fmt, "constraints": rules})
    return sealed({"table": table, "columns": columns})


def sealed(proposal: dict) -> dict:
    body = {k: v for k, v in proposal.items() if k != "seal"}
    return body | {"seal": hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}


def edited(proposal: dict, edits: list[dict]) -> dict:
    """Apply typed edits: set_semantic, add_constraint, drop_constraint. The seal must still fit."""
    if sealed(proposal)["seal"] != proposal.get("seal"):
        raise ValueError("the proposal was changed outside its edits")
    out = json.loads(json.dumps(proposal))
    at = {c["name"]: c for c in out["columns"]}
    for e in edits:
        column = at[e["column"]]
        if e["op"] == "set_semantic":
            column["semantic"] = e["semantic"]
        elif e["op"] == "add_constraint":
            column["constraints"].append(e["constraint"])
        elif e["op"] == "drop_constraint":
            column["constraints"] = [c for c in column["constraints"] if c["type"] != e["type"]]
        else:
            raise ValueError(f"unknown edit {e['op']}")
    return sealed(out)


def to_constraints(proposal: dict) -> list[dict]:
    return [r for c in proposal["columns"] for r in c["constraints"]]
