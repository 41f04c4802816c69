"""Rules as Spark plans.

A rule belongs to its owner table: the child-most table it names. Attributes of tables above come in
by left joins along foreign keys, first parent wins; aggregates over child tables are computed per
key and joined, never joined and then grouped. All rules of one owner share one joined frame and one
aggregation. Truth is three-valued: a row violates a rule only where the rule is FALSE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.schema import ForeignKey, Graph

from .language import Call, Literal, Name, RuleError, atoms, parse, walk

AGGREGATES = {"SUM", "COUNT", "AVG", "MIN", "MAX"}
SCALARS = {"ABS": 1, "ROUND": 2, "LOWER": 1, "UPPER": 1, "LEN": 1, "DATEDIFF": 2}


@dataclass
class Compiled:
    """A rule that is resolved against tables and keys."""

    name: str
    text: str
    tree: object
    owner: str
    kind: str  # derive, bound, conditional, unique or check
    target: tuple[str, str] | None
    reads: frozenset[tuple[str, str]]

    def describe(self) -> str:
        return f"{self.name} [{self.kind}] on {self.owner}: {self.text}"


class Resolver:
    """Column names and types of tables, and the graph between them."""

    def __init__(self, columns: dict[str, dict[str, str]], graph: Graph, default: str | None = None):
        self.columns, self.graph, self.default = columns, graph, default

    def name(self, n: Name, home: str | None) -> tuple[str, str]:
        if n.table:
            if n.column not in self.columns.get(n.table, {}):
                raise RuleError(f"unknown column {n.table}.{n.column}")
            return n.table, n.column
        for t in (home, self.default):
            if t and n.column in self.columns.get(t, {}):
                return t, n.column
        hits = [t for t, c in self.columns.items() if n.column in c]
        if len(hits) != 1:
            raise RuleError(f"{'ambiguous' if hits else 'unknown'} column {n.column}")
        return hits[0], n.column

    def bound(self, node, home: str | None = None):
        """The tree with every name qualified; aggregates get their table as first argument."""
        if isinstance(node, Name):
            return Name(*self.name(node, home))
        if not isinstance(node, Call):
            return node
        if node.op in AGGREGATES:
            if len(node.args) != 1:
                raise RuleError(f"{node.op} takes one argument")
            arg = node.args[0]
            if node.op == "COUNT" and isinstance(arg, Name) and not arg.table and arg.column in self.columns:
                return Call("COUNT", (arg.column, None))
            names = [x for x in walk(arg) if isinstance(x, Name)]
            tables = {self.name(x, None)[0] for x in names}
            child = self.lowest(tables)
            return Call(node.op, (child, self.bound(arg, child)))
        if node.op.isupper() and node.op not in SCALARS and node.op != "UNIQUE":
            raise RuleError(f"unknown function {node.op}")
        return Call(node.op, tuple(self.bound(a, home) for a in node.args))

    def lowest(self, tables: set[str]) -> str:
        for t in sorted(tables):
            if all(self.graph.path(t, u) is not None for u in tables):
                return t
        raise RuleError(f"no foreign keys join {', '.join(sorted(tables))}")

    def compile(self, text: str, name: str) -> Compiled:
        tree = self.bound(parse(text))
        plain = [x for x in _outer(tree) if isinstance(x, Name)]
        inner = [x for x in walk_bound(tree) if isinstance(x, Call) and x.op in AGGREGATES]
        if plain:
            owner = self.lowest({x.table for x in plain})
        elif inner:
            ups = self.graph.parents(inner[0].args[0])
            if not ups:
                raise RuleError(f"{inner[0].args[0]} has no parent to aggregate for")
            owner = ups[0].parent
        else:
            raise RuleError("a rule names a column at least")
        for a in inner:
            if self.graph.path(a.args[0], owner) in (None, []):
                raise RuleError(f"{a.args[0]} is not below {owner}")
        reads = frozenset((x.table, x.column) for x in walk_bound(tree) if isinstance(x, Name)) | {(a.args[0], "*") for a in inner if a.args[1] is None}
        kind, target = self.classify(tree, owner)
        return Compiled(name, text, tree, owner, kind, target, reads)

    def keys(self) -> set[tuple[str, str]]:
        held = {(k.child, c) for k in self.graph.keys for c in k.columns}
        return held | {(t.name, c) for t in self.graph.tables.values() for c in t.key}

    def classify(self, tree, owner: str) -> tuple[str, tuple[str, str] | None]:
        """What kind of rule it is, and the column that a repair would change; keys never change."""

        def free(n) -> tuple[str, str] | None:
            return (n.table, n.column) if isinstance(n, Name) and (n.table, n.column) not in self.keys() else None

        if not isinstance(tree, Call):
            return "check", None
        if tree.op == "UNIQUE":
            return "unique", free(tree.args[0])
        if tree.op == "implies":
            return "conditional", next((t for a in atoms(tree.args[1]) if isinstance(a, Call) and a.args and (t := free(a.args[0]))), None)
        if tree.op == "=" and (t := free(tree.args[0])):
            return ("bound" if isinstance(tree.args[1], Literal) else "derive"), t
        if tree.op in {"<", "<=", ">", ">=", "between", "in", "notnull"}:
            for a in tree.args[: 2 if tree.op in {"<", "<=", ">", ">="} else 1]:
                if t := free(a):
                    return "bound", t
        return "check", None


def walk_bound(node):
    yield node
    if isinstance(node, Call):
        for a in node.args:
            if not isinstance(a, str) and a is not None:
                yield from walk_bound(a)


def _outer(node):
    """Nodes outside aggregates."""
    if isinstance(node, Call) and node.op in AGGREGATES:
        return
    yield node
    if isinstance(node, Call):
        for a in node.args:
            yield from _outer(a)


class Frames:
    """Joined frames of owner tables, with ancestor columns and child aggregates as needed."""

    def __init__(self, tables: dict[str, DataFrame], graph: Graph):
        self.tables, self.graph = tables, graph
        self.types = {(t, c): kind for t, df in tables.items() for c, kind in df.dtypes}

    def first_by(self, table: str, columns: tuple[str, ...], wanted: list[str]) -> DataFrame:
        """One row for each key of ``table``: of a repeated key, the one with the smallest wanted columns.

        A partially aggregated minimum over the wanted columns alone, so that nothing else is read.
        """
        rest = [c for c in wanted if c not in columns]
        df = self.tables[table].where(" and ".join(f"`{c}` is not null" for c in columns))
        if not rest:
            return df.select(*columns).distinct()
        least = F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__row")
        return df.groupBy(*columns).agg(least).select(*columns, *[F.col(f"__row.`{c}`").alias(c) for c in rest])

    def climb(self, df: DataFrame, start: str, names: set[tuple[str, str]], tag: str) -> DataFrame:
        """``df`` of ``start`` (columns tagged) with the columns ``names`` of tables above it."""
        done: set[str] = {start}
        wanted: dict[str, set[str]] = {}
        chains = []
        for t in sorted({t for t, _ in names} - {start}):
            chain = self.graph.path(start, t)
            chains.append(chain)
            wanted.setdefault(t, set()).update(c for u, c in names if u == t)
            for here, after in zip(chain, chain[1:], strict=False):
                wanted.setdefault(here.parent, set()).update(after.columns)
        for chain in chains:
            for k in chain:
                if k.parent in done:
                    continue
                done.add(k.parent)
                up = self.first_by(k.parent, k.parent_columns, sorted(wanted.get(k.parent, set())))
                cols = [F.col(f"`{c}`").alias(f"{tag}{k.parent}.{c}") for c in dict.fromkeys([*k.parent_columns, *sorted(wanted.get(k.parent, ()))])]
                up = up.select(*cols)
                on = [F.col(f"`{tag}{k.child}.{c}`") == F.col(f"`{tag}{k.parent}.{p}`") for c, p in zip(k.columns, k.parent_columns, strict=True)]
                df = df.join(up, on, "left")
        return df

    def tagged(self, table: str, tag: str = "") -> DataFrame:
        return self.tables[table].select(*[F.col(f"`{c}`").alias(f"{tag}{table}.{c}") for c in self.tables[table].columns])

    def owner_frame(self, rules: list[Compiled]) -> tuple[DataFrame, dict]:
        """The frame of the rules' owner, and the column of each aggregate in it."""
        owner = rules[0].owner
        names = {(x.table, x.column) for r in rules for x in _outer(r.tree) if isinstance(x, Name)}
        df = self.climb(self.tagged(owner), owner, names, "")
        made: dict = {}
        calls = list(dict.fromkeys(x for r in rules for x in walk_bound(r.tree) if isinstance(x, Call) and x.op in AGGREGATES))
        for child in dict.fromkeys(c.args[0] for c in calls):
            mine = [c for c in calls if c.args[0] == child]
            chain = self.graph.path(child, owner)
            inner = {(x.table, x.column) for c in mine if c.args[1] is not None for x in walk_bound(c.args[1]) if isinstance(x, Name)}
            last: ForeignKey = chain[-1]
            need = inner | ({(last.child, c) for c in last.columns} if last.child != child else set())
            below = self.climb(self.tagged(child), child, need, "")
            key = [F.col(f"`{last.child}.{c}`") for c in last.columns]
            aggs = []
            for i, c in enumerate(mine):
                value = None if c.args[1] is None else expression(c.args[1], self.types, {})
                label = f"__agg_{child}_{i}"
                made[c] = F.coalesce(F.col(f"`{label}`"), F.lit(0)) if c.op in {"SUM", "COUNT"} else F.col(f"`{label}`")
                aggs.append({"COUNT": lambda v: F.count(F.lit(1) if v is None else v), "SUM": lambda v: F.sum(scalars.number(v)), "AVG": lambda v: F.avg(scalars.number(v)), "MIN": F.min, "MAX": F.max}[c.op](value).alias(label))
            labels = [f"__key_{child}_{i}" for i in range(len(key))]
            grouped = below.groupBy(*[k.alias(n) for k, n in zip(key, labels, strict=True)]).agg(*aggs)
            on = [F.col(f"`{owner}.{p}`") == F.col(f"`{n}`") for p, n in zip(last.parent_columns, labels, strict=True)]
            df = df.join(grouped, on, "left")
        uniques = list(dict.fromkeys(x for r in rules for x in walk_bound(r.tree) if isinstance(x, Call) and x.op == "UNIQUE"))
        for i, u in enumerate(uniques):
            value = expression(u.args[0], self.types, made)
            apart = F.when(value.isNull(), F.xxhash64(*[F.col(f"`{owner}.{c}`") for c in self.tables[owner].columns]))
            order = Window.partitionBy(value, apart).orderBy(*[F.col(f"`{owner}.{c}`") for c in self.tables[owner].columns])
            df = df.withColumn(f"__seen_{i}", F.when(value.isNotNull(), F.row_number().over(order)))
            made[u] = F.coalesce(F.col(f"__seen_{i}") == 1, F.lit(True))
        return df, made


def _type(node, types: dict[tuple[str, str], str]) -> str:
    if isinstance(node, Name):
        kind = types[node.table, node.column]
        return "time" if kind.startswith(("date", "timestamp")) else "text" if kind == "string" else "number"
    if isinstance(node, Literal):
        return "number" if isinstance(node.value, float) else "text"
    if node.op in {"MIN", "MAX"} and node.args[1] is not None:
        return _type(node.args[1], types)
    return "text" if node.op in {"LOWER", "UPPER"} else "number"


def expression(node, types: dict[tuple[str, str], str], made: dict) -> Column:
    """The column of a bound tree over a joined frame."""
    if isinstance(node, Literal):
        return F.lit(node.value)
    if isinstance(node, Name):
        return F.col(f"`{node.table}.{node.column}`")
    if node in made:
        return made[node]
    op = node.op
    if op in {"=", "!=", "<", "<=", ">", ">="}:
        left, right = (expression(a, types, made) for a in node.args)
        return scalars.compare(op, left, right, _type(node.args[0], types), _type(node.args[1], types))
    a = [expression(x, types, made) for x in node.args]
    if op in {"+", "-", "*", "/"}:
        return scalars.arithmetic(op, scalars.number(a[0]), scalars.number(a[1]))
    plain = {
        "implies": lambda: ~a[0] | a[1], "or": lambda: a[0] | a[1], "and": lambda: a[0] & a[1], "not": lambda: ~a[0],
        "neg": lambda: -scalars.number(a[0]), "isnull": lambda: a[0].isNull(), "notnull": lambda: a[0].isNotNull(),
        "between": lambda: scalars.compare(">=", a[0], a[1], _type(node.args[0], types), _type(node.args[1], types)) & scalars.compare("<=", a[0], a[2], _type(node.args[0], types), _type(node.args[2], types)),
        "ABS": lambda: F.abs(scalars.number(a[0])), "ROUND": lambda: scalars.half_even(a[0], int(node.args[1].value) if len(a) > 1 else 0),
        "LOWER": lambda: F.lower(a[0].cast("string")), "UPPER": lambda: F.upper(a[0].cast("string")), "LEN": lambda: F.char_length(a[0].cast("string")),
        "DATEDIFF": lambda: scalars.days_between(a[0], a[1]),
    }
    if op == "in":
        return scalars.member(a[0], a[1:], _type(node.args[0], types))
    return plain[op]()


def violated(rule: Compiled, types: dict[tuple[str, str], str], made: dict) -> Column:
    """Whether a row of the owner's frame violates the rule: FALSE does, unknown does not."""
    return ~F.coalesce(expression(rule.tree, types, made).cast("boolean"), F.lit(True))


def compile_rules(texts: list[str] | dict[str, str], tables: dict[str, DataFrame], graph: Graph, default: str | None = None) -> list[Compiled]:
    """Rules R1, R2, ... (or by their given names) resolved against ``tables``."""
    named = texts if isinstance(texts, dict) else {f"R{i + 1}": t for i, t in enumerate(texts)}
    resolver = Resolver({t: dict(df.dtypes) for t, df in tables.items()}, graph, default or (next(iter(tables)) if len(tables) == 1 else None))
    return [resolver.compile(text, name) for name, text in named.items()]


def report(rules: list[Compiled], tables: dict[str, DataFrame], graph: Graph) -> DataFrame:
    """One row per rule: rule, owner, kind, checked, violations, unknown. One aggregation per owner."""
    frames, parts = Frames(tables, graph), []
    for owner in dict.fromkeys(r.owner for r in rules):
        mine = [r for r in rules if r.owner == owner]
        df, made = frames.owner_frame(mine)
        aggs = [F.count(F.lit(1)).alias("checked")]
        for i, r in enumerate(mine):
            truth = expression(r.tree, frames.types, made).cast("boolean")
            aggs += [F.count_if(~truth).alias(f"v{i}"), F.count_if(truth.isNull()).alias(f"u{i}")]
        rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.owner).alias("owner"), F.lit(r.kind).alias("kind"), F.col("checked"), F.col(f"v{i}").alias("violations"), F.col(f"u{i}").alias("unknown")) for i, r in enumerate(mine)])
        parts.append(df.agg(*aggs).select(F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(rule: Compiled, tables: dict[str, DataFrame], graph: Graph) -> DataFrame:
    """The owner's rows that violate the rule, with the owner's columns."""
    frames = Frames(tables, graph)
    df, made = frames.owner_frame([rule])
    return df.where(violated(rule, frames.types, made)).select(*[F.col(f"`{rule.owner}.{c}`").alias(c) for c in tables[rule.owner].columns])
