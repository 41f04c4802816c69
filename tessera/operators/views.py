"""Compact summaries of a real and a synthetic dataset for charts: small dictionaries, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import batches, inference, integrity, neighbours, people, scoring, stats
from tessera.schema import Graph, family

#: Most bytes of a payload.
CEILING = 30_000


def chartable(df: DataFrame) -> list[str]:
    """Numeric columns worth a histogram: over ten values, no unique integers, no names that end in id."""
    nums = [c for c, t in df.dtypes if family(t) in {"int", "float"} and not c.lower().endswith("id")]
    if not nums:
        return []
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(nums)]).first()
    return [c for i, c in enumerate(nums) if row[f"d{i}"] > 10 and not (family(dict(df.dtypes)[c]) == "int" and row[f"d{i}"] == row["n"])]


def distribution(real: DataFrame, synthetic: DataFrame, column: str, bins: int = 20) -> dict:
    """Shares of both in equal bins over the joint range."""
    v = F.col(f"`{column}`").cast("double")
    edges = [df.agg(F.min(v), F.max(v)).first() for df in (real, synthetic)]
    low, high = min(e[0] for e in edges if e[0] is not None), max(e[1] for e in edges if e[1] is not None)
    high = high if high > low else low + 1
    sides = [{r["bin"]: r["share"] for r in stats.histogram(df, column, bins, low, high).collect()} for df in (real, synthetic)]
    return {"type": "distribution", "column": column, "low": low, "high": high, "real": [round(sides[0].get(i, 0.0), 6) for i in range(1, bins + 1)], "synthetic": [round(sides[1].get(i, 0.0), 6) for i in range(1, bins + 1)]}


def categorical(real: DataFrame, synthetic: DataFrame, column: str, top: int = 10) -> dict:
    """Shares of the real side's most frequent values; rare ones as one."""
    values = [r["value"] for r in stats.frequencies(real, column, top, least=5).collect()]
    out = {"type": "categorical", "column": column, "values": sorted(values), "match": round(100 * (1 - (stats.tvd(real, synthetic, column).first()["tvd"] or 0.0)), 4)}
    for side, df in (("real", real), ("synthetic", synthetic)):
        named = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.when(F.col(f"`{column}`").cast("string").isin(*values), F.col(f"`{column}`").cast("string")).otherwise("other").alias("v")).count().collect()
        total = sum(r["count"] for r in named) or 1
        shares = {r["v"]: r["count"] / total for r in named}
        out[side] = [round(shares.get(v, 0.0), 6) for v in out["values"]]
    return out


def correlation(real: DataFrame, synthetic: DataFrame, worst: int = 3) -> dict:
    """Pearson matrices as pairs, and the pairs that differ most."""
    cols = chartable(real)[:12]
    a, b = ({(r["a"], r["b"]): r["r"] for r in stats.correlations(df, cols).collect()} for df in (real, synthetic)) if len(cols) > 1 else ({}, {})
    pairs = [{"a": k[0], "b": k[1], "real": a[k], "synthetic": b[k]} for k in a]
    gaps = sorted((p for p in pairs if p["real"] is not None and p["synthetic"] is not None), key=lambda p: -abs(p["real"] - p["synthetic"]))
    return {"type": "correlation", "pairs": pairs, "worst": gaps[:worst]}


def missing(real: DataFrame, synthetic: DataFrame) -> dict:
    return {"type": "missing", **{side: {r["column"]: round(r["rate"] or 0.0, 6) for r in stats.null_rates(df).collect()} for side, df in (("real", real), ("synthetic", synthetic))}}


def cardinality(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], graph: Graph) -> dict:
    """Children per parent, capped at ten, for every foreign key."""
    out = []
    for k in graph.keys:
        sides = [{r["children"]: r["parents"] for r in inference.children_histogram(t[k.child], t[k.parent], k).collect()} for t in (real, synthetic)]
        out.append({"key": k.name, "real": [sides[0].get(i, 0) for i in range(11)], "synthetic": [sides[1].get(i, 0) for i in range(11)]})
    return {"type": "cardinality", "keys": out}


def integrity_view(tables: dict[str, DataFrame], graph: Graph) -> dict:
    return {"type": "integrity", "faults": [r.asDict() for r in integrity.report(tables, graph).collect()]}


def scores(real: DataFrame, synthetic: DataFrame) -> dict:
    return {"type": "scores", "columns": scoring.column_scores(real, synthetic)}


def overview(tables: dict[str, DataFrame]) -> dict:
    return {"type": "overview", "tables": [{"name": n, "rows": df.count(), "columns": len(df.columns)} for n, df in tables.items()]}


def privacy_distance(train: DataFrame, synthetic: DataFrame, holdout: DataFrame, row_id: str = "__id", bins: int = 20) -> dict:
    """How far synthetic rows lie from their closest training row, beside how far held-out rows do: shares in equal bins from 0."""
    model = scoring.encoder(train.drop(row_id))
    vec = lambda df, base: df.select((F.col(f"`{row_id}`").cast("long") + base).alias("id"), scoring.encoded(df, model).alias("v"))
    index = neighbours.Index.build(vec(train, 0), "id", "v")
    sides = [index.nearest(vec(df, (i + 1) << 40), "id", "v").checkpoint() for i, df in enumerate((synthetic, holdout))]
    ends = [d.agg(F.max("distance").alias("m"), F.avg((F.col("distance") == 0).cast("double")).alias("zero")).first() for d in sides]
    high = max((e["m"] for e in ends if e["m"] is not None), default=0.0) or 1.0
    shares = [{r["bin"]: r["share"] for r in stats.histogram(d, "distance", bins, 0.0, high).collect()} for d in sides]
    out = {"type": "privacy_distance", "low": 0.0, "high": high}
    for name, s, e in zip(("synthetic", "baseline"), shares, ends, strict=True):
        out |= {name: [round(s.get(i, 0.0), 6) for i in range(1, bins + 1)], f"{name}_zero": round(e["zero"] or 0.0, 6)}
    return out


def tstr(train: DataFrame, test: DataFrame, synthetic: DataFrame, target: str, seed: int = 0) -> dict:
    """Every model's measures, trained on real and on synthetic rows, with the gap in percent."""
    found = scoring.tstr(train, test, synthetic, target, seed)
    models = {n: {k: {"real": m["real"][k], "synthetic": m["synthetic"][k], "gap_pct": m["gaps"][k]} for k in m["real"]} for n, m in found["models"].items()}
    return {"type": "tstr", "target": target, "task": found["task"], "primary": found["primary"], "mean_gap_pct": found["mean_gap_pct"], "models": models}


def locale_validity(rows: DataFrame, packs: dict[str, dict] | None = None) -> dict:
    """Checks of generated people against their locales: failures and pass rates, and the worst check."""
    checks = [r.asDict() for r in people.coherence(rows, packs).collect()]
    worst = min(checks, key=lambda c: (c["pass_pct"] if c["pass_pct"] is not None else 100.0, c["check"]), default=None)
    return {"type": "locale_validity", "checks": checks, "worst": worst["check"] if worst and worst["failures"] else None}


def batch_summary(results: DataFrame) -> dict:
    """A document batch: produced, failed, shares of success and of exact reconciliation, and failures by stage."""
    rows = batches.tally(results).collect()
    total = sum(r["documents"] for r in rows)
    good = sum(r["documents"] for r in rows if r["status"] != "failed")
    stages: dict[str, int] = {}
    for r in rows:
        if r["status"] == "failed":
            stages[r["stage"]] = stages.get(r["stage"], 0) + r["documents"]
    unreconciled = sum(stages.get(s, 0) for s in ("reconcile", "post_validate"))
    share = lambda n: round(100.0 * n / total, 2) if total else 100.0
    return {"type": "batch_summary", "total": total, "succeeded": good, "failed": total - good, "success_pct": share(good), "reconciled_pct": share(total - unreconciled), "by_stage": stages}
