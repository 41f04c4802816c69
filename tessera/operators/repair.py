"""Repairs of rule violations, as column rewrites."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashing, scalars
from tessera.operators import stats
from tessera.operators.rules import plans
from tessera.operators.rules.language import Call, Literal, Name, atoms
from tessera.schema import Graph


def decimals(df: DataFrame, column: str, most: int = 4) -> int:
    """The fewest decimal places, up to ``most``, that reproduce every value."""
    c = F.col(f"`{column}`").cast("double")
    row = df.agg(*[F.max((F.abs(F.bround(c, d) - c) > 1e-9).cast("int")).alias(f"d{d}") for d in range(most)]).first()
    return next((d for d in range(most) if not row[f"d{d}"]), most)


def derived(current: Column, value: Column, places: int | None) -> Column:
    """``value`` where it is known, rounded half-even to ``places``; else the current value."""
    made = value if places is None else F.bround(value, places)
    return F.coalesce(made, current)


def reflected(current: Column, bound: Column, op: str, unit: float) -> Column:
    """A number mirrored across a bound it breaks: strict bounds keep one ``unit`` away."""
    gap = F.lit(unit if op in {"<", ">"} else 0.0)
    bad = ~F.coalesce({"<": current < bound, "<=": current <= bound, ">": current > bound, ">=": current >= bound}[op], F.lit(True))
    mirror = 2 * bound - current
    made = F.least(mirror, bound - gap) if op in {"<", "<="} else F.greatest(mirror, bound + gap)
    return F.when(bad, made).otherwise(current)


def shifted_date(current: Column, bound: Column, op: str, seed: int, row_id: Column) -> Column:
    """A time that breaks a bound becomes the bound and up to three days beyond it; NULL stays."""
    low = 1 if op in {"<", ">"} else 0
    days = hashing.integer(seed, "date-repair", row_id, low, 3)
    bad = ~F.coalesce({"<": current < bound, "<=": current <= bound, ">": current > bound, ">=": current >= bound}[op], F.lit(True))
    step = F.make_dt_interval(days.cast("int"))
    return F.when(bad, bound - step if op in {"<", "<="} else bound + step).otherwise(current)


def renumbered(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Second and later rows of a repeated value: integers go on after the maximum, text gets ``-k``."""
    kind = dict(df.dtypes)[column]
    place = F.row_number().over(Window.partitionBy(column, F.when(F.col(column).isNull(), F.xxhash64(*order))).orderBy(*order))
    tagged = df.withColumn("__k", F.when(F.col(column).isNotNull(), place).otherwise(1))
    if kind == "string":
        return tagged.withColumn(column, F.when(F.col("__k") > 1, F.concat(F.col(column), F.lit("-"), F.col("__k").cast("string"))).otherwise(F.col(column))).drop("__k")
    if kind in {"double", "float"}:
        raise ValueError("fractions are not renumbered")
    # the k-th row of a value gets the maximum, plus the repeats of all smaller values, plus k - 1: a
    # running sum over the repeated values alone, taken in ranges
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.count(F.lit(1)) - 1).alias("__extra")).where("__extra > 0")
    before = stats.cumulative(values, column, {"__before": "__extra"}, strict=True).select(F.col(column).alias("__value"), "__before")
    top = df.agg(F.max(column).alias("__top"))
    fixed = tagged.where("__k > 1").join(before, F.col(column) == F.col("__value")).crossJoin(F.broadcast(top))
    fixed = fixed.withColumn(column, (F.col("__top") + F.col("__before") + F.col("__k") - 1).cast(kind)).select(*df.columns)
    return tagged.where("__k = 1").drop("__k").unionByName(fixed)


@dataclass
class Report:
    """Violations of each rule before and after, and rules that no rewrite could satisfy."""

    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)
    unrepaired: dict[str, str] = field(default_factory=dict)
    passes: int = 0

    @property
    def pass_rate(self) -> float:
        return 1.0 if not self.after else sum(1 for v in self.after.values() if v == 0) / len(self.after)


def ordered(rules: list[plans.Compiled]) -> list[plans.Compiled]:
    """Derive rules after the rules that make what they read, then bounds, unique, conditional and check rules."""
    rank = {"derive": 0, "bound": 1, "unique": 2, "conditional": 3, "check": 4}
    derive = [r for r in rules if r.kind == "derive"]
    out: list[plans.Compiled] = []
    while derive:
        free = [r for r in derive if not any(o is not r and o.target in r.reads for o in derive)] or derive[:1]
        out += free
        derive = [r for r in derive if r not in free]
    return out + sorted((r for r in rules if r.kind != "derive"), key=lambda r: rank[r.kind])


def _rewrite(rule: plans.Compiled, tables: dict[str, DataFrame], graph: Graph, seed: int, row_id: dict[str, str]) -> dict[str, DataFrame]:
    """``tables`` with the rule's target column rewritten where the rule is violated."""
    frames = plans.Frames(tables, graph)
    df, made = frames.owner_frame([rule])
    owner, (table, column) = rule.owner, rule.target
    current, bad = F.col(f"`{table}.{column}`"), plans.violated(rule, frames.types, made)
    tree, kind = rule.tree, frames.types[rule.target]
    if tree.op == "implies":
        tree = next(a for a in atoms(tree.args[1]) if isinstance(a, Call) and a.args and a.args[0] == Name(table, column))
    value = lambda n: plans.expression(n, frames.types, made)
    if tree.op == "=":
        places = None if isinstance(tree.args[1], (Name, Literal)) else min(decimals(tables[table], column), 2)
        new = derived(current, value(tree.args[1]).cast(kind) if places is None else scalars.number(value(tree.args[1])), places)
    elif tree.op in {"<", "<=", ">", ">="}:
        left = tree.args[0] == Name(table, column)
        op = tree.op if left else {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[tree.op]
        bound = value(tree.args[1] if left else tree.args[0])
        if kind.startswith(("timestamp", "date")):
            new = shifted_date(current, bound, op, seed, F.col(f"`{owner}.{row_id[owner]}`"))
        else:
            unit = 1.0 if kind in {"int", "bigint", "smallint", "tinyint"} else 10.0 ** -decimals(tables[table], column)
            new = reflected(current, scalars.number(bound), op, unit)
    elif tree.op == "between":
        new = F.greatest(value(tree.args[1]), F.least(value(tree.args[2]), current))
    elif tree.op == "in":
        options = [a.value for a in tree.args[1:]]
        new = hashing.pick(seed, "in-repair", F.col(f"`{owner}.{row_id[owner]}`"), options)
    elif tree.op == "notnull":
        pool = [r[0] for r in tables[table].where(F.col(f"`{column}`").isNotNull()).groupBy(f"`{column}`").count().orderBy(F.desc("count"), f"`{column}`").limit(20).select(f"`{column}`").collect()]
        new = hashing.pick(seed, "null-repair", F.col(f"`{owner}.{row_id[owner]}`"), pool) if pool else current
    else:
        return tables
    new = F.when(bad, new.cast(kind)).otherwise(current)
    if table == owner:
        cols = [new.alias(c) if c == column else F.col(f"`{owner}.{c}`").alias(c) for c in tables[owner].columns]
        return tables | {owner: df.select(*cols)}
    # the target is in a table above: of several repaired children the smallest value decides
    key = graph.path(owner, table)[-1].parent_columns
    made_for = df.where(bad).groupBy(*[F.col(f"`{table}.{k}`").alias(f"__{k}") for k in key]).agg(F.min(new).alias("__new"))
    on = [F.col(f"`{k}`") == F.col(f"__{k}") for k in key]
    joined = tables[table].join(made_for, on, "left")
    return tables | {table: joined.select(*[F.coalesce("__new", f"`{c}`").alias(c) if c == column else F.col(f"`{c}`") for c in tables[table].columns])}


def enforce(tables: dict[str, DataFrame], graph: Graph, texts: list[str], row_id: dict[str, str], seed: int = 0, passes: int = 4) -> tuple[dict[str, DataFrame], Report]:
    """Rewrite ``tables`` until no rule changes anything, at most ``passes`` times.

    Keys never change. Rules without a repairable target are reported. The checkpoint folder must be
    set: each pass is cut there, so that plans stay short and survive lost executors.
    """
    rules = ordered(plans.compile_rules(texts, tables, graph))
    counts = lambda: {r.rule: r.violations for r in plans.report(rules, tables, graph).collect()}
    out = Report(before=counts())
    left = out.before
    for _ in range(passes):
        if not any(left.values()):
            break
        out.passes += 1
        for rule in rules:
            if not left[rule.name]:
                continue
            if rule.kind == "unique" and rule.target:
                tables = tables | {rule.owner: renumbered(tables[rule.owner], rule.target[1], [row_id[rule.owner]])}
            elif rule.kind in {"derive", "bound", "conditional"} and rule.target:
                tables = _rewrite(rule, tables, graph, seed, row_id)
            else:
                out.unrepaired[rule.name] = "no column can be rewritten"
        tables = {t: df.checkpoint() for t, df in tables.items()}
        now = counts()
        if now == left:
            break
        left = now
    out.after = left
    for name, n in left.items():
        if n:
            out.unrepaired.setdefault(name, f"{n} rows still break it")
    return tables, out
