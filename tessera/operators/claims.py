"""Claims about tables, proposed by a person or a model, each held against the data before it counts.

    {"kind": "type", "table": t, "column": c, "type": y, "format": f}    y a pattern of ``semantics``, number, or date with ``format``
    {"kind": "reference", "child": t, "columns": [...], "parent": u, "parent_columns": [...]}
    {"kind": "constraint", "table": t, ...}                             the rest as in ``constraints``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import constraints, inference, semantics
from tessera.schema import ForeignKey, Graph, Table, family

#: Least share of values, or of child keys, for which a claim must hold.
LEAST = {"pattern": 0.8, "number": 1.0, "date": 0.9, "reference": 0.8}


def _fits(claim: dict) -> tuple[Column, float]:
    """Whether a non-empty value is of the claimed type, and the share that must be."""
    v = F.trim(F.col(f"`{claim['column']}`").cast("string"))
    if claim["type"] == "number":
        return v.try_cast("double").isNotNull(), LEAST["number"]
    if claim["type"] == "date":
        return F.try_to_timestamp(v, F.lit(claim["format"])).isNotNull(), LEAST["date"]
    return v.rlike(semantics.PATTERNS[claim["type"]]), LEAST["pattern"]


def fault_of(claim: dict, tables: dict[str, DataFrame]) -> str | None:
    """Why a claim cannot be checked at all."""
    named = {"type": [("table", "column")], "reference": [("child", "columns"), ("parent", "parent_columns")], "constraint": [("table", "column")]}.get(claim.get("kind"))
    if named is None:
        return "unknown kind"
    for table, columns in named:
        if claim.get(table) not in tables:
            return f"unknown table {claim.get(table)}"
        wanted = claim.get(columns, [])
        for c in [wanted] if isinstance(wanted, str) else wanted:
            if c not in tables[claim[table]].columns:
                return f"unknown column {c}"
    if claim["kind"] == "type" and claim.get("type") not in {*semantics.PATTERNS, "number", "date"}:
        return f"unknown type {claim.get('type')}"
    if claim["kind"] == "type" and claim["type"] == "date" and not claim.get("format"):
        return "a date needs its format"
    return None


def held(tables: dict[str, DataFrame], graph: Graph, claims: list[dict]) -> tuple[Graph, list[dict]]:
    """(graph with the references that hold, a verdict for each claim: accepted, share, reason).

    Type claims and constraints of a table are checked in one aggregation each; a reference is a join of
    distinct keys. A constraint that rows break is refused, with the share of rows that keep it.
    """
    verdicts: list[dict] = [{"accepted": False, "share": None, "reason": fault_of(c, tables)} for c in claims]
    out = Graph([Table(t.name, dict(t.columns), t.key) for t in graph.tables.values()], graph.keys)
    open_ones = [i for i, v in enumerate(verdicts) if v["reason"] is None]
    for name, df in tables.items():
        typed = [i for i in open_ones if claims[i]["kind"] == "type" and claims[i]["table"] == name]
        if typed:
            checks = [_fits(claims[i]) for i in typed]
            present = [F.trim(F.col(f"`{claims[i]['column']}`").cast("string")) != "" for i in typed]
            row = df.agg(*[F.avg(F.when(p, fits.cast("double"))).alias(f"s{i}") for i, p, (fits, _) in zip(typed, present, checks, strict=True)]).first()
            for i, (_, least) in zip(typed, checks, strict=True):
                share = row[f"s{i}"] or 0.0
                verdicts[i] = {"accepted": share >= least, "share": share, "reason": f"{share:.0%} of the values fit"}
        ruled = [i for i in open_ones if claims[i]["kind"] == "constraint" and claims[i]["table"] == name]
        if ruled:
            specs = [{k: v for k, v in claims[i].items() if k not in {"kind", "table"}} for i in ruled]
            for i, r in zip(ruled, constraints.report(df, specs).collect(), strict=False):  # one row per constraint
                share = 1 - r["violations"] / r["rows"] if r["rows"] else 1.0
                verdicts[i] = {"accepted": r["violations"] == 0, "share": share, "reason": f"{r['violations']} rows break it"}
    for i in open_ones:
        c = claims[i]
        if c["kind"] != "reference":
            continue
        own, theirs = tuple(c["columns"]), tuple(c["parent_columns"])
        share = inference.overlap(tables[c["child"]], own, tables[c["parent"]], theirs)
        verdicts[i] = {"accepted": share >= LEAST["reference"], "share": share, "reason": f"{share:.0%} of the keys are found"}
        key = ForeignKey(c["child"], own, c["parent"], theirs, confidence=round(share, 4), source="claimed")
        if share >= LEAST["reference"] and key.name not in {k.name for k in out.keys}:
            for t in (key.child, key.parent):
                if t not in out.tables:
                    out.tables[t] = Table(t, {n: family(k) for n, k in tables[t].dtypes})
            try:
                out.add(key)
            except ValueError as why:
                verdicts[i] |= {"accepted": False, "reason": str(why)}
    return out, verdicts
