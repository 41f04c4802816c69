"""Synthetic rows: profiles, Gaussian copulas, injection, edge cases, child counts.

Every value is a function of the seed, a stream name and the row id, so results do not depend on
partitioning, and every generator is one narrow projection over ``spark.range``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions.normal import phi, phi_inverse, phi_inverse_of, phi_of
from tessera.operators import stats
from tessera.schema import family

#: Points of a quantile grid.
GRID = 101
#: Most values that a profile or a draw holds on the driver; more are kept as a table.
FEW = 1_000
#: Ranges of [0, 1) by which a draw meets a table of shares.
RANGES = 1_024


@dataclass
class Profile:
    """What is kept of one column: kind (numeric, datetime, category or identifier) and its marginal."""

    name: str
    kind: str
    type: str
    grid: list[float] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)
    prefix: str = ""
    width: int = 6
    null_rate: float = 0.0
    #: (v, n, low, high): all values with their counts and their parts of [0, 1), where they are too many for ``values``.
    table: DataFrame | None = None


def shares_table(counts: DataFrame) -> DataFrame:
    """(v, n, low, high) of a frame (v, n): each value's part of [0, 1), in the order of a hash of the values."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    placed = stats.cumulative(counts.select("v", "n", F.xxhash64("v").cast("double").alias("__o")), "__o", {"before": "n"}, strict=True)
    return placed.select("v", "n", (F.col("before") / total).alias("low"), ((F.col("before") + F.col("n")) / total).alias("high"))


def drawn(df: DataFrame, u: str, table: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` with ``name``: the value of ``table`` (v, low, high) whose part of [0, 1) holds the column ``u``.

    Both sides meet on a range of u, then by comparison; a frequent value lies in many ranges, so no range
    holds more than its share of the rows.
    """
    parts = table.select(F.col("v").cast(kind).alias(name), F.col("low").alias("__low"), F.col("high").alias("__high"), F.explode(F.sequence(F.floor(F.col("low") * RANGES), F.least(F.floor(F.col("high") * RANGES), F.lit(RANGES - 1)))).alias("__range"))
    keyed = df.withColumn("__at", F.least(F.floor(F.col(u) * RANGES), F.lit(RANGES - 1)))
    return keyed.join(parts, (F.col("__at") == F.col("__range")) & (F.col(u) >= F.col("__low")) & (F.col(u) < F.col("__high")), "left").drop("__at", "__range", "__low", "__high")


def profile(df: DataFrame, columns: list[str] | None = None) -> list[Profile]:
    """Profiles of all columns, from two aggregations and one frequency table per category."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    kinds = {c: family(types[c]) for c in columns}
    ranged = {c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if kinds[c] == "datetime" else F.col(f"`{c}`") for i, c in enumerate(columns) if kinds[c] in {"datetime", "float"} or (kinds[c] == "int" and first[f"d{i}"] > 10)}
    grids = stats.quantile_grids(df, ranged, GRID) if ranged else {}
    out = []
    for i, c in enumerate(columns):
        kind, present, distinct = kinds[c], first[f"c{i}"], first[f"d{i}"]
        p = Profile(c, "category", types[c], null_rate=1 - present / first["n"] if first["n"] else 0.0)
        if c in ranged:
            p.kind = "datetime" if kind == "datetime" else "numeric"
            p.grid = grids.get(c) or [0.0] * GRID
        elif kind == "str" and distinct >= 50 and distinct > 0.5 * present:
            p.kind = "identifier"
            sample = df.where(F.col(f"`{c}`").isNotNull()).agg(F.min(f"`{c}`")).first()[0]
            p.prefix = sample.rstrip("0123456789")
            p.width = max(1, len(sample) - len(p.prefix))
        else:
            counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            if distinct > FEW:
                p.table = shares_table(counts)
            else:
                rows = counts.orderBy(F.desc("n"), "v").collect()
                p.values, p.shares = [r["v"] for r in rows], [r["n"] / (present or 1) for r in rows]
        out.append(p)
    return out


def marginal(p: Profile, u: Column, row_id: Column) -> Column:
    """The value of a profile at quantile ``u``."""
    if p.kind == "identifier":
        return F.concat(F.lit(p.prefix), F.lpad((row_id + 1).cast("string"), p.width, "0"))
    if p.kind == "category":
        return hashing.by_share(u, p.values or [None], p.shares or [1.0]).cast(p.type)
    grid, m = F.array(*[F.lit(float(g)) for g in p.grid]), len(p.grid) - 1
    at = u * m
    low = F.least(F.floor(at), F.lit(m - 1)).cast("int")
    value = F.element_at(grid, low + 1) + (at - low) * (F.element_at(grid, low + 2) - F.element_at(grid, low + 1))
    if p.kind == "datetime":
        return F.timestamp_micros(value.cast("long")).cast(p.type)
    return F.bround(value, 0).cast(p.type) if family(p.type) == "int" else value.cast(p.type)


@dataclass
class Copula:
    """Marginals and the correlation of their normal scores."""

    profiles: list[Profile]
    correlation: np.ndarray
    #: Mean and deviation of each column's normal scores, which are below 0 and 1 where few values share ranks.
    scores: list[tuple[float, float]] = field(default_factory=list)

    @property
    def factor(self) -> np.ndarray:
        return np.linalg.cholesky(self.correlation)


def valid_correlation(c: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """The matrix with eigenvalues of ``least`` at least and a unit diagonal."""
    c = np.nan_to_num((c + c.T) / 2)
    np.fill_diagonal(c, 1.0)
    w, v = np.linalg.eigh(c)
    c = v @ np.diag(np.maximum(w, least)) @ v.T
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def normal_scores(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """z0, z1, ...: each value's mean rank over (n + 1), through the inverse normal; from value counts alone.

    All columns are counted and ranked in one pass; the cells then meet their scores in one join, by row.
    """
    made, columns = df, {}
    for i, p in enumerate(profiles):
        c = F.col(f"`{p.name}`")
        if p.kind in {"datetime", "numeric"}:
            v = F.unix_micros(c.cast("timestamp")).cast("double") if p.kind == "datetime" else c.cast("double")
        elif p.table is not None:
            # a category is ranked by its place in the profile: the part of [0, 1) of many values, frequent ones first of few
            parts = p.table.select(F.col("v").alias(f"__pv{i}"), F.col("low").alias(f"__v{i}"))
            made = made.join(parts, c.cast("string") == F.col(f"__pv{i}"), "left")
            v = F.col(f"__v{i}")
        else:
            place = F.array_position(F.array(*[F.lit(x) for x in p.values]), c.cast("string")) if p.values else F.lit(None)
            v = F.when(c.isNotNull() & (place > 0), place.cast("double"))
        columns[p.name] = v
    values = made.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(columns.values())])
    named = {f"v{i}": F.col(f"v{i}") for i in range(len(profiles))}
    ranks = stats.running_counts(stats.value_counts(values, named))
    scores = ranks.select("i", "v", phi_inverse((F.col("before") + (F.col("c") + 1) / 2) / (F.col("n") + 1)).alias("z")).checkpoint()
    return stats.looked_up(values, scores, "z", "z")


def fit(df: DataFrame, columns: list[str] | None = None) -> Copula:
    profiles = profile(df, columns)
    used = [p for p in profiles if p.kind != "identifier"]
    z = normal_scores(df, used)
    c = np.eye(len(used))
    scores = []
    if used:
        found = stats.comoments(z, [f"z{i}" for i in range(len(used))])
        for i in range(len(used)):
            for j in range(i + 1, len(used)):
                c[i, j] = c[j, i] = found.correlation(i, j) or 0.0  # none for a column of one value
        scores = [(found.mean(i), found.deviation(i) or 1.0) for i in range(len(used))]
    return Copula(profiles, valid_correlation(c), scores)


def from_spec(spec: list[dict], correlations: dict[tuple[str, str], float] | None = None) -> Copula:
    """A copula from a column specification alone: numeric (mean, std) or (min, max), category weights, date range."""
    from statistics import NormalDist

    probes = [min(max(i / (GRID - 1), 1e-4), 1 - 1e-4) for i in range(GRID)]
    out = []
    for s in spec:
        if "values" in s:
            w = s.get("weights") or [1.0] * len(s["values"])
            out.append(Profile(s["name"], "category", s.get("type", "string"), values=[str(v) for v in s["values"]], shares=[x / sum(w) for x in w]))
        else:
            kind = s.get("type", "double")
            if "mean" in s:
                grid = [NormalDist(s["mean"], s["std"]).inv_cdf(q) for q in probes]
            else:
                grid = [s["min"] + i / (GRID - 1) * (s["max"] - s["min"]) for i in range(GRID)]
            out.append(Profile(s["name"], "datetime" if family(kind) == "datetime" else "numeric", kind, grid=grid))
    c = np.eye(len(out))
    at = {p.name: i for i, p in enumerate(out)}
    for (a, b), r in (correlations or {}).items():
        c[at[a], at[b]] = c[at[b], at[a]] = r
    return Copula(out, valid_correlation(c))


def sample(spark: SparkSession, model: Copula, n: int, seed: int = 0, given: DataFrame | None = None) -> DataFrame:
    """``n`` rows: z = L e, u = phi(z), inverse marginals. All columns are codegen expressions."""
    df = spark.range(n).withColumnRenamed("id", "__id")
    used = [p for p in model.profiles if p.kind != "identifier"]
    e = [hashing.gaussian(seed, f"copula/{p.name}", F.col("__id")).alias(f"__e{i}") for i, p in enumerate(used)]
    df = df.select("__id", *e)
    z = [sum((F.lit(float(model.factor[i, j])) * F.col(f"__e{j}") for j in range(i + 1)), F.lit(0.0)).alias(f"__z{i}") for i in range(len(used))]
    df = df.select("__id", *z)
    place = {p.name: i for i, p in enumerate(used)}
    for i, p in enumerate(used):
        if p.table is not None:
            df = drawn(df.withColumn("__u", phi(F.col(f"__z{i}"))), "__u", p.table, f"__t{i}", p.type)
    cols = [(F.col(f"__t{place[p.name]}") if p.table is not None else marginal(p, phi(F.col(f"__z{place[p.name]}")) if p.name in place else F.lit(0.0), F.col("__id"))).alias(p.name) for p in model.profiles]
    return df.select("__id", *cols)


def sample_given(model: Copula, given: DataFrame, row_id: str, columns: list[str], seed: int = 0) -> DataFrame:
    """The model's other columns for each row of ``given``, which has numeric ``columns`` of the model.

    The conditional normal has mean K z and a fixed covariance; unseen and NULL values condition nothing.
    """
    used = [p for p in model.profiles if p.kind != "identifier"]
    a = [i for i, p in enumerate(used) if p.name in columns]
    b = [i for i in range(len(used)) if i not in a]
    c = model.correlation
    gain = c[np.ix_(b, a)] @ np.linalg.inv(c[np.ix_(a, a)])
    root = np.linalg.cholesky(valid_covariance(c[np.ix_(b, b)] - gain @ c[np.ix_(a, b)]))
    # the sums and the normal distribution are worked in arrays: as expressions they make methods too long to be compiled
    df = given.withColumns({f"__e{k}": hashing.gaussian(seed, f"given/{used[i].name}", F.col(row_id)) for k, i in enumerate(b)})
    scores = [model.scores[i] if model.scores else (0.0, 1.0) for i in a]
    grids = [np.array(used[i].grid, np.float64) for i in a]

    @F.arrow_udf(", ".join(f"u{k} double" for k in range(len(b))))
    def placed(*columns: pa.Array) -> pa.Array:
        given_scores = np.zeros((len(columns[0]), len(a)))
        for k, c in enumerate(columns[: len(a)]):
            score = (phi_inverse_of(quantile_of(grids[k], c.to_numpy(zero_copy_only=False))) - scores[k][0]) / scores[k][1]
            given_scores[:, k] = np.where(c.is_null().to_numpy(zero_copy_only=False), 0.0, score)
        noise = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns[len(a) :]])
        u = phi_of(given_scores @ gain.T + noise @ np.tril(root).T)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(u[:, k])) for k in range(len(b))], names=[f"u{k}" for k in range(len(b))])

    if b:
        df = df.withColumn("__gs", placed(*[number(used[i], F.col(f"`{used[i].name}`")) for i in a], *[F.col(f"__e{k}") for k in range(len(b))]))
        df = df.withColumns({f"__gu{k}": F.col(f"__gs.u{k}") for k in range(len(b))})
    for k, i in enumerate(b):
        if used[i].table is not None:
            df = drawn(df, f"__gu{k}", used[i].table, used[i].name, used[i].type)
        else:
            df = df.withColumn(used[i].name, marginal(used[i], F.col(f"__gu{k}"), F.col(row_id)))
    for p in model.profiles:
        if p.kind == "identifier":
            df = df.withColumn(p.name, marginal(p, F.lit(0.0), F.col(row_id)))
    return df.drop(*[c for c in df.columns if c.startswith(("__g", "__e"))])


def valid_covariance(c: np.ndarray, least: float = 1e-9) -> np.ndarray:
    w, v = np.linalg.eigh((c + c.T) / 2)
    return v @ np.diag(np.maximum(w, least)) @ v.T


def number(p: Profile, c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") if p.kind == "datetime" else c.cast("double")


def quantile_of(grid: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The places of values in a numeric marginal, within (0, 1)."""
    passed = np.searchsorted(grid, values, "left") + np.searchsorted(grid, values, "right")
    return np.clip(passed / (2.0 * len(grid)), 1e-6, 1 - 1e-6)


# injection

def nulls_injected(df: DataFrame, column: str, rate: float, seed: int, row_id: str) -> DataFrame:
    """Exactly round(rate * n) values of ``column`` become NULL."""
    k = int(rate * df.count() + 0.5)
    chosen = hashing.exactly(df.select(row_id), k, seed, f"null/{column}", row_id).withColumn("__hit", F.lit(True))
    hit = df.join(chosen, row_id, "left")
    return hit.select(*[F.when(F.col("__hit"), None).otherwise(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def outliers_injected(df: DataFrame, column: str, rate: float, seed: int, row_id: str, method: str = "iqr") -> DataFrame:
    """Exactly round(rate * n) present values become outliers: beyond the quartiles, by deviations, or scaled."""
    v = F.col(f"`{column}`").cast("double")
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(F.lit(1)).alias("rows")).first()
    k = int(rate * s["rows"] + 0.5)
    chosen = hashing.exactly(df.where(v.isNotNull()).select(row_id), k, seed, f"outlier/{column}", row_id).withColumn("__hit", F.lit(True))
    u, side = hashing.uniform(seed, f"size/{column}", F.col(row_id)), hashing.uniform(seed, f"side/{column}", F.col(row_id)) < 0.5
    quarters = stats.quantiles(df, column, 5) if method == "iqr" else None
    q1, q3 = (quarters[1], quarters[3]) if quarters else (0.0, 0.0)
    spread = (q3 - q1) or 1.0
    made = {
        "iqr": F.when(side, F.lit(q3) + (1.5 + 1.5 * u) * spread).otherwise(F.lit(q1) - (1.5 + 1.5 * u) * spread),
        "zscore": F.when(side, F.lit(s["mean"]) + (4 + 2 * u) * (s["std"] or 1.0)).otherwise(F.lit(s["mean"]) - (4 + 2 * u) * (s["std"] or 1.0)),
        "scale": v * (5 + 5 * u),
    }[method]
    kind = dict(df.dtypes)[column]
    made = F.bround(made, 0).cast(kind) if family(kind) == "int" else made.cast(kind)
    hit = df.join(chosen, row_id, "left")
    return hit.select(*[F.when(F.col("__hit"), made).otherwise(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


# edge cases

def _typo(case: str, c: Column, at: Column) -> Column:
    """One edit at an inner place (from 1) of a text."""
    before, after = F.substr(c, F.lit(1), at - 1), F.substr(c, at + 1, F.length(c))
    here, nxt = F.substr(c, at, F.lit(1)), F.substr(c, at + 1, F.lit(1))
    return {
        "swap": F.concat(before, nxt, here, F.substr(c, at + 2, F.length(c))),
        "drop": F.concat(before, after),
        "double": F.concat(before, here, here, after),
        "case": F.concat(before, F.when(F.upper(here) == here, F.lower(here)).otherwise(F.upper(here)), after),
        "neighbour": F.concat(before, F.translate(here, "qwertyuiopasdfghjklzxcvbnm", "wertyuiopqsdfghjklaxcvbnmz"), after),
        "space": F.concat(before, F.lit(" "), here, after),
    }[case]


def _when_type(kind: str, pack: str) -> dict[str, object]:
    """case -> value (a constant, or a function of the column) for a column family."""
    number = {"zero": 0, "minus_one": -1, "max": 2**31 - 1, "min": -(2**31)}
    return {
        ("boundary_values", "int"): number, ("boundary_values", "float"): {**{k: float(v) for k, v in number.items()}, "tiny": 5e-324},
        ("boundary_values", "str"): {"empty": "", "blank": " ", "long": "x" * 1024},
        ("boundary_values", "datetime"): {"epoch": "1970-01-01 00:00:00", "far": "2262-04-11 00:00:00"},
        ("negative_balances", "int"): {"negated": lambda c: -F.abs(c) - 1, "small": -1}, ("negative_balances", "float"): {"negated": lambda c: -F.abs(c) - 0.01, "small": -0.01},
        ("leap_year_dates", "datetime"): {"leap_day": "2024-02-29", "before": "2024-02-28", "after": "2024-03-01", "century": "2000-02-29"},
        ("timezone_shifts", "datetime"): {"plus": lambda c: c + F.expr("interval 14 hours"), "minus": lambda c: c - F.expr("interval 12 hours"), "gap": "2024-03-31 02:30:00", "overlap": "2024-10-27 02:30:00", "last_second": lambda c: F.date_trunc("day", c) + F.expr("interval 86399 seconds")},
        ("typos", "str"): {k: k for k in ("swap", "drop", "double", "case", "neighbour", "space")},
    }.get((pack, kind), {})


def edge_cases(df: DataFrame, column: str, pack: str, rate: float, seed: int, row_id: str) -> DataFrame:
    """round(rate * n) rows get the pack's cases in turn in ``column``; ``_edge_case`` names pack and case.

    Dates keep their time of day where the case names a day only; typos need three letters.
    """
    kind = dict(df.dtypes)[column]
    cases = _when_type(family(kind), pack)
    if not cases:
        raise ValueError(f"{pack} has no case for {kind}")
    c = F.col(f"`{column}`")
    fit_rows = df.where(F.length(c) >= 3) if pack == "typos" else df.where(c.isNotNull())
    k = int(rate * df.count() + 0.5)
    stream = f"edge/{pack}/{column}"
    top = hashing.exactly(fit_rows.select(row_id), k, seed, stream, row_id)
    numbered = top.select(row_id, hashing.uniform(seed, stream, F.col(row_id)).alias("__u"), F.lit(1).alias("__one"))
    chosen = stats.cumulative(numbered, "__u", {"__turn": "__one"}, strict=True).select(row_id, "__turn")
    hit = df.join(chosen, row_id, "left")
    out, tag = None, None
    for i, (case, value) in enumerate(cases.items()):
        if pack == "typos":
            at = hashing.integer(seed, "typo/place", F.col(row_id), 0, 1_000_000) % (F.length(c) - 2) + 2
            made = _typo(case, c, at.cast("int"))
        elif callable(value):
            made = value(c)
        elif pack == "leap_year_dates":
            made = F.to_timestamp_ntz(F.lit(value)) + (c.cast("timestamp_ntz") - F.date_trunc("day", c).cast("timestamp_ntz"))
        else:
            made = F.lit(value)
        mine = F.col("__turn") % len(cases) == i
        made = made.cast(kind) if not (family(kind) == "int" and isinstance(value, int)) else F.lit(value).try_cast(kind)
        out = F.when(mine, made) if out is None else out.when(mine, made)
        tag = F.when(mine, F.lit(f"{pack}:{case}")) if tag is None else tag.when(mine, F.lit(f"{pack}:{case}"))
    return hit.select(*[out.otherwise(c).alias(n) if n == column else F.col(f"`{n}`") for n in df.columns], tag.alias("_edge_case"))


def duplicates_added(df: DataFrame, column: str, rate: float, seed: int, row_id: str) -> DataFrame:
    """round(rate * n) rows again: as they are, with blanks around ``column``, or with its case swapped."""
    k = int(rate * df.count() + 0.5)
    c = F.col(f"`{column}`")
    picked = hashing.exactly(df, k, seed, "duplicates", row_id)
    turn = F.pmod(F.xxhash64(F.col(row_id)), F.lit(3))
    made = F.when(turn == 1, F.concat(F.lit(" "), c, F.lit(" "))).when(turn == 2, F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c))).otherwise(c)
    tag = F.when(turn == 1, "duplicates:blanks").when(turn == 2, "duplicates:case").otherwise("duplicates:exact")
    copies = picked.select(*[made.alias(n) if n == column else F.col(f"`{n}`") for n in df.columns], tag.alias("_edge_case"))
    return df.withColumn("_edge_case", F.lit(None).cast("string")).unionByName(copies)


# relational

def child_counts(parents: DataFrame, parent_id: str, kind: str, seed: int, stream: str, *, lam: float = 2.0, value: int = 1, learned: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """``parents`` with ``children``: poisson, fixed, zipf (``most`` at most), or drawn from ``learned`` (v, n, low, high)."""
    u = hashing.uniform(seed, f"children/{stream}", F.col(parent_id))
    if kind == "fixed":
        n = F.lit(value)
    elif kind == "poisson":
        n = hashing.poisson(u, lam)
    elif kind == "zipf":
        n = F.least(F.lit(most), F.floor(F.pow(F.greatest(1 - u, F.lit(1e-12)), F.lit(-1.0 / max(lam - 1, 0.05))))).cast("int")
    elif kind == "learned":
        return drawn(parents.withColumn("__u", u), "__u", learned, "children", "int").drop("__u")
    else:
        raise ValueError(f"unknown cardinality {kind}")
    return parents.withColumn("children", n.cast("int"))


def fit_to_total(counts: DataFrame, parent_id: str, total: int, seed: int) -> DataFrame:
    """``counts`` (children) nudged by one where needed so that they sum to ``total``; hashes decide where."""
    have, n = counts.agg(F.coalesce(F.sum("children"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    gap = total - have
    if not n or not gap:
        return counts
    step, rest = divmod(abs(gap), n)
    sign = 1 if gap > 0 else -1
    chosen = hashing.exactly(counts.select(parent_id), rest, seed, "fit", parent_id).withColumn("__more", F.lit(1))
    out = counts.join(chosen, parent_id, "left").withColumn("children", F.greatest(F.lit(0), F.col("children") + sign * (step + F.coalesce("__more", F.lit(0)))).cast("int"))
    return out.drop("__more")


def exploded(parents: DataFrame, parent_id: str, fk: str, line: str = "line") -> DataFrame:
    """One row per child: ``fk`` and the running number within the parent."""
    return parents.where("children > 0").select(F.col(parent_id).alias(fk), F.explode(F.sequence(F.lit(1), F.col("children"))).alias(line))


def other_reference(children: DataFrame, row_id: str, n_parents: int, seed: int, stream: str, null_rate: float = 0.0) -> Column:
    """A second foreign key with popular parents: squares of uniforms favour small numbers, shuffled by a
    multiplication with a number that has no common divisor with ``n_parents``, so that all parents are reached."""
    factor = next(f for f in count(7919) if gcd(f, n_parents) == 1)
    u = hashing.uniform(seed, f"fk/{stream}", F.col(row_id))
    rank = F.floor(u * u * n_parents)
    key = F.pmod(rank * factor + 13, F.lit(n_parents)) + 1
    none = hashing.uniform(seed, f"fk-null/{stream}", F.col(row_id)) < null_rate
    return F.when(~none, key.cast("long"))


def self_reference(row_id: Column, seed: int, root_rate: float = 0.05) -> Column:
    """A parent strictly before the row, so that the references form a forest; roots are NULL. Ids count from 1."""
    u = hashing.uniform(seed, "self", row_id)
    root = (row_id <= 1) | (hashing.uniform(seed, "self-root", row_id) < root_rate)
    return F.when(~root, (F.floor(u * (row_id - 1)) + 1).cast("long"))
