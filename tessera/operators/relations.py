"""Effects across tables: how a child's numbers depend on attributes of its ancestors, real against synthetic.

All pairs of one child table are measured together. Its rows get the attributes of ancestors once. One aggregation,
melted over the categories, gives counts, sums and squares of every number by group. Ranks of all numbers come from
one melted running count, and all rank correlations from one aggregation over the rows' ranks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import relational, stats
from tessera.schema import Graph, family

#: Least rows of an ancestor for group effects, least effects that count, most effects compared, tolerances.
ANCESTOR_ROWS, LEAST_ETA2, LEAST_RANK, MOST = 60, 0.02, 0.2, 8
PROFILE, ETA2, RANK = 0.5, 0.15, 0.3


@dataclass
class Effect:
    kind: str  # "group" (eta squared) or "rank" (Spearman)
    child: str
    child_column: str
    ancestor: str
    ancestor_column: str
    value: float | None
    deviation: float | None = None
    means: dict[str, float] = field(default_factory=dict)

    @property
    def pair(self) -> tuple[str, str, str, str, str]:
        return self.kind, self.child, self.child_column, self.ancestor, self.ancestor_column


def ranked_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """r0, r1, ...: the mean rank of each row's value among the present values of its column, for all columns in one pass and one join."""
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    named = {f"v{i}": F.col(f"v{i}") for i in range(len(columns))}
    ranks = stats.running_counts(stats.value_counts(values, named)).select("i", "v", (F.col("before") + (F.col("c") + 1) / 2).alias("r")).checkpoint()
    return stats.looked_up(values, ranks, "r", "r")


def effects(tables: dict[str, DataFrame], graph: Graph, child: str, known: dict[str, dict[str, int]], rows: dict[str, int], depth: int = relational.DEPTH) -> list[Effect]:
    """Every effect of an ancestor's attribute on a number of ``child``; None where it cannot be measured.

    ``known`` has the attributes of each table with their numbers of values, ``rows`` the tables' row counts.
    Categories have 2 to 12 values and are no times; numbers have more. Ranks are taken over all present values of a
    column, correlations over the rows where both are present.
    """
    few = relational.STRATA_VALUES
    kinds = {t: {c: family(k) for c, k in tables[t].dtypes} for t in tables}
    numbers = lambda t: [c for c, n in known[t].items() if kinds[t][c] in {"int", "float"} and n > few]
    groups = lambda t: [c for c, n in known[t].items() if n <= few and kinds[t][c] != "datetime"]
    ys = numbers(child)
    above = [a for a in graph.ancestors(child, depth) if a in tables]
    cats = [(a, c) for a in above if rows[a] >= ANCESTOR_ROWS for c in groups(a)]
    nums = [(a, c) for a in above for c in numbers(a)]
    if not ys or not (cats or nums):
        return []
    wanted: dict[str, list[str]] = {}
    for a, c in cats + nums:
        wanted.setdefault(a, []).append(c)
    wide = relational.lifted(tables[child], child, wanted, tables, graph)
    wide = wide.select(*[F.col(f"`{c}`").cast("double").alias(f"y{j}") for j, c in enumerate(ys)], *[F.col(f"`{a}.{c}`").cast("string").alias(f"g{i}") for i, (a, c) in enumerate(cats)], *[F.col(f"`{a}.{c}`").cast("double").alias(f"x{i}") for i, (a, c) in enumerate(nums)]).checkpoint()
    out = []
    if cats:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"g{i}").alias("g")) for i in range(len(cats))])
        melted = wide.select(*[f"y{j}" for j in range(len(ys))], F.explode(cells).alias("s")).select("*", "s.*").where("g is not null")
        sums = [f(e).alias(f"{n}{j}") for j in range(len(ys)) for n, f, e in (("n", F.count, F.col(f"y{j}")), ("s", F.sum, F.col(f"y{j}")), ("q", F.sum, F.col(f"y{j}") * F.col(f"y{j}")))]
        found = melted.groupBy("i", "g").agg(*sums).collect()  # at most twelve groups of a category
        spreads = wide.agg(*[F.stddev_samp(f"y{j}").alias(f"d{j}") for j in range(len(ys))]).first()
        for i, (a, c) in enumerate(cats):
            for j, y in enumerate(ys):
                parts = [(r["g"], r[f"n{j}"], r[f"s{j}"], r[f"q{j}"]) for r in found if r["i"] == i and r[f"n{j}"]]
                n, s, q = (sum(p[k] for p in parts) for k in (1, 2, 3))
                spread = q - s * s / n if n else 0.0
                eta2 = sum(m * (t / m - s / n) ** 2 for _, m, t, _ in parts) / spread if n >= 10 and spread > 1e-12 * q else None
                out.append(Effect("group", child, y, a, c, eta2, spreads[f"d{j}"], {g: t / m for g, m, t, _ in parts}))
    if nums:
        names = [f"x{i}" for i in range(len(nums))] + [f"y{j}" for j in range(len(ys))]
        ranks = ranked_rows(wide, names)
        found = stats.comoments(ranks, [f"r{k}" for k in range(len(names))])
        out += [Effect("rank", child, ys[j], *nums[i], found.correlation(i, len(nums) + j)) for i in range(len(nums)) for j in range(len(ys))]
    return out


def strongest(found: list[Effect], most: int = MOST) -> list[Effect]:
    """The strongest effects that count, ties by name."""
    good = [e for e in found if e.value is not None and abs(e.value) >= (LEAST_ETA2 if e.kind == "group" else LEAST_RANK)]
    return sorted(good, key=lambda e: (-abs(e.value), e.pair))[:most]


def compared(real: Effect, synthetic: Effect | None) -> float:
    """0 to 100: how well the synthetic effect follows the real one, for groups in their means too."""
    other = synthetic.value if synthetic is not None and synthetic.value is not None else 0.0
    if real.kind == "rank":
        return 100 * max(0.0, 1 - abs(real.value - other) / RANK)
    means = synthetic.means if synthetic is not None else {}
    middle = sum(real.means.values()) / len(real.means)
    error = sum(abs(m - means.get(g, middle)) for g, m in real.means.items()) / len(real.means) / (real.deviation or 1.0) if real.means.keys() & means.keys() else 1.0
    return 60 * max(0.0, 1 - error / PROFILE) + 40 * max(0.0, 1 - abs(real.value - other) / ETA2)


def measured(tables: dict[str, DataFrame], graph: Graph) -> list[Effect]:
    """All effects of a dataset."""
    inside = Graph([t for t in graph.tables.values() if t.name in tables], [k for k in graph.keys if k.child in tables and k.parent in tables])
    known = {t: relational.attributes(inside, t, tables[t]) for t in inside.tables}
    rows = {t: tables[t].count() for t in inside.tables}
    return [e for t in inside.tables for e in effects(tables, inside, t, known, rows)]


def cross_table(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], graph: Graph) -> tuple[float | None, list[dict]]:
    """The mean score of the strongest real effects, and each with both values."""
    chosen = strongest(measured(real, graph))
    if not chosen:
        return None, []
    made = {e.pair: e for e in measured(synthetic, graph)}
    rows = [{"kind": e.kind, "child": e.child, "child_column": e.child_column, "ancestor": e.ancestor, "ancestor_column": e.ancestor_column, "real": e.value, "synthetic": made[e.pair].value if e.pair in made else None, "score": compared(e, made.get(e.pair))} for e in chosen]
    return sum(r["score"] for r in rows) / len(rows), rows


def join_sizes(tables: dict[str, DataFrame], graph: Graph, depth: int = 3) -> dict[tuple[str, str], float]:
    """(ancestor, table) -> rows of the table that reach a row of the ancestor, for each of the ancestor's rows; one pass a table."""
    inside = Graph([t for t in graph.tables.values() if t.name in tables], [k for k in graph.keys if k.child in tables and k.parent in tables])
    rows = {t: tables[t].count() for t in inside.tables}
    out = {}
    for t in inside.tables:
        above = inside.ancestors(t, depth)
        if not above:
            continue
        marked = tables | {a: tables[a].withColumn("__here", F.lit(1)) for a in above}
        wide = relational.lifted(tables[t], t, {a: ["__here"] for a in above}, marked, inside)
        met = wide.agg(*[F.count(f"`{a}.__here`").alias(f"n{i}") for i, a in enumerate(above)]).first()
        for i, a in enumerate(above):
            out[a, t] = met[f"n{i}"] / max(1, rows[a])
    return out
