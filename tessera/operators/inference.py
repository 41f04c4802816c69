"""Primary keys, foreign keys and cardinalities from data; schemas from DDL."""

from __future__ import annotations

import math
import re
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import ForeignKey, Graph, Table, family, normal, singular


def key_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, rows, nulls, distinct for every int and text column: one aggregation per table."""
    parts = []
    for t, df in tables.items():
        cols = [c for c, k in df.dtypes if family(k) in {"int", "str"}]
        made = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)])
        rows = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.col("n").alias("rows"), (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(cols)])
        parts.append(made.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def keyish(column: str) -> bool:
    """Whether a name looks like a key."""
    n = normal(column)
    return n in {"id", "key", "code", "uuid"} or n.endswith(("_id", "_key", "_code", "_uuid", "_no"))


def names_table(column: str, table: str) -> bool:
    """Whether a column is named after a table: customer_id and customers."""
    stem = re.sub(r"_(id|key|code|uuid|no)$", "", normal(column))
    return stem == singular(table)


def primary_key(table: str, df: DataFrame, stats: dict[str, dict]) -> tuple[str, ...]:
    """The likeliest key: a unique column without nulls, by name, type and place; else a unique pair of key-like columns."""
    order = list(df.columns)

    def score(c: str) -> float:
        kind = family(dict(df.dtypes)[c])
        return 3.0 * (normal(c) == "id" or names_table(c, table)) + keyish(c) + (kind == "int") + 0.5 * (c == order[0])

    whole = [c for c, s in stats.items() if s["rows"] and not s["nulls"] and s["distinct"] == s["rows"]]
    # a unique column that names another table is more likely a one-to-one reference than the key
    named = sorted((c for c in whole if score(c) >= 1), key=lambda c: (-score(c), order.index(c)))
    if named:
        return (named[0],)
    several = unique_sets(df, {c: stats[c]["distinct"] for c in stats if keyish(c) and not stats[c]["nulls"]}, stats[order[0]]["rows"] if order[0] in stats else None, first=True)
    if several:
        return several[0]
    return (min(whole, key=order.index),) if whole else ()


#: Most columns of a key, sets looked at in one aggregation by sketch and by exact count, and the least estimate that is counted exactly.
KEY_COLUMNS, SKETCHED, COUNTED, LIKELY = 3, 128, 8, 0.9
#: Repeats are looked for in one of so many parts of the rows first.
PARTS = 64


def repeating(df: DataFrame, sets: list[tuple[str, ...]], distinct: dict[str, int]) -> set[tuple[str, ...]]:
    """Those of ``sets`` whose values repeat within one part of the rows, which shows that they are not unique.

    A part has all rows of some values of the set's column with the most values. What repeats in other parts only is not found.
    """
    found: set[tuple[str, ...]] = set()
    for lead in dict.fromkeys(max(c, key=distinct.__getitem__) for c in sets):
        some = [c for c in sets if max(c, key=distinct.__getitem__) == lead]
        part = df.where(F.pmod(F.xxhash64(F.col(f"`{lead}`")), F.lit(PARTS)) == 0)
        row = part.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(*[F.col(f"`{x}`") for x in c]).alias(f"p{i}") for i, c in enumerate(some)]).first()
        found |= {c for i, c in enumerate(some) if row[f"p{i}"] < row["n"]}
    return found


def unique_sets(df: DataFrame, distinct: dict[str, int], rows: int | None = None, most: int = KEY_COLUMNS, first: bool = False) -> list[tuple[str, ...]]:
    """The smallest sets of two to ``most`` columns whose values together are unique; ``first``: those of the fewest columns, the first found.

    ``distinct`` has the columns, none of which holds nulls or is unique, with their numbers of values. Level by level: a set
    is looked at if no part of it is unique and the product of its columns' values reaches the number of rows; a sketch of
    all such sets in one aggregation leaves those near uniqueness, and those that repeat within a part of the rows are not
    unique; all others are counted exactly, over all rows.
    """
    rows = df.count() if rows is None else rows
    found: list[tuple[str, ...]] = []
    for size in range(2, most + 1) if rows else ():
        wanted = [c for c in combinations(distinct, size) if math.prod(distinct[x] for x in c) >= rows and not any(set(f) <= set(c) for f in found)]
        for at in range(0, len(wanted), SKETCHED):
            some = wanted[at : at + SKETCHED]
            seen = df.agg(*[F.approx_count_distinct(F.xxhash64(*[F.col(f"`{x}`") for x in c]), 0.02).alias(f"p{i}") for i, c in enumerate(some)]).first()
            near = [c for i, c in enumerate(some) if seen[f"p{i}"] >= LIKELY * rows]
            again = repeating(df, near, distinct)
            near = [c for c in near if c not in again]
            for k in range(0, len(near), COUNTED):
                part = near[k : k + COUNTED]
                exact = df.agg(*[F.count_distinct(*[F.col(f"`{x}`") for x in c]).alias(f"p{i}") for i, c in enumerate(part)]).first()
                found += [c for i, c in enumerate(part) if exact[f"p{i}"] == rows]
                if first and found:
                    return found
    return found


def overlap(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, keys: tuple[str, ...]) -> float:
    """Share of the child's whole keys that the parent has."""
    own = child.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]).dropna().groupBy(*[f"k{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]).distinct().withColumn("hit", F.lit(1))
    row = own.join(known, [f"k{i}" for i in range(len(columns))], "left").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("n"))).alias("hit")).first()
    return (row["hit"] or 0) / row["n"] if row["n"] else 0.0


def infer(tables: dict[str, DataFrame], least: float = 0.98) -> Graph:
    """Keys and foreign keys of ``tables``.

    Integer columns need name evidence, since small integers fit many tables; a column gets its best
    parent only. Candidates are pruned by type and name before any pair is compared.
    """
    stats: dict[str, dict[str, dict]] = {t: {} for t in tables}
    for r in key_stats(tables).collect():  # one row per column
        stats[r["table"]][r["column"]] = r.asDict()
    found = [Table(t, {c: family(k) for c, k in df.dtypes}, primary_key(t, df, stats[t])) for t, df in tables.items()]
    graph = Graph(found)
    for child in found:
        for column, s in stats[child.name].items():
            best: tuple[float, ForeignKey] | None = None
            for parent in found:
                if len(parent.key) != 1 or (parent.name == child.name and parent.key[0] == column):
                    continue
                key, kind = parent.key[0], child.columns[column]
                own_key = child.key == (column,)
                named = names_table(column, parent.name) or (normal(column) == normal(key) and not own_key)
                role = parent.name == child.name and keyish(column) and not any(names_table(column, t.name) for t in found) and column not in child.key
                if kind != parent.columns[key] or not s["distinct"]:
                    continue
                if (kind == "int" or s["distinct"] < 5) and not (named or role):
                    continue
                share = overlap(tables[child.name], (column,), tables[parent.name], (key,))
                confidence = share * (1.0 if named else 0.8)
                if share >= least and (best is None or confidence > best[0]):
                    best = confidence, ForeignKey(child.name, (column,), parent.name, (key,), nullable=s["nulls"] > 0, confidence=round(confidence, 4), source="inferred")
            if best:
                graph.keys.append(best[1])
        for parent in found:
            if parent.name != child.name and len(parent.key) > 1 and set(parent.key) <= set(child.columns):
                share = overlap(tables[child.name], parent.key, tables[parent.name], parent.key)
                if share >= least:
                    graph.keys.append(ForeignKey(child.name, parent.key, parent.name, parent.key, confidence=round(share, 4), source="inferred"))
    return graph


def children(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """The parent's key columns and ``children``, zeros included."""
    own = child.groupBy(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key.columns)]).agg(F.count(F.lit(1)).alias("n"))
    on = [F.col(f"`{p}`") == F.col(f"__k{i}") for i, p in enumerate(key.parent_columns)]
    return parent.select(*[f"`{p}`" for p in key.parent_columns]).join(own, on, "left").select(*key.parent_columns, F.coalesce("n", F.lit(0)).alias("children"))


def cardinality(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """One row: key, parents, mean, max, zero_fraction, null_rate, cardinality."""
    null_rate = child.agg(F.avg(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in key.columns]).cast("double")).alias("null_rate"))
    n = children(child, parent, key).agg(F.count(F.lit(1)).alias("parents"), F.avg("children").alias("mean"), F.max("children").alias("max"), F.avg((F.col("children") == 0).cast("double")).alias("zero_fraction"))
    return n.crossJoin(F.broadcast(null_rate)).select(F.lit(key.name).alias("key"), "parents", "mean", "max", "zero_fraction", "null_rate", F.when(F.col("max") <= 1, "1:1").otherwise("1:N").alias("cardinality"))


def children_histogram(child: DataFrame, parent: DataFrame, key: ForeignKey, most: int = 10) -> DataFrame:
    """children (capped at ``most``), parents."""
    return children(child, parent, key).groupBy(F.least("children", F.lit(most)).alias("children")).agg(F.count(F.lit(1)).alias("parents"))


def path_size(tables: dict[str, DataFrame], graph: Graph, start: str, end: str) -> DataFrame:
    """One row: rows of ``start`` that reach a row of ``end`` through their foreign keys, and rows per row of ``end``."""
    df, at = tables[start], None
    for i, k in enumerate(graph.path(start, end)):
        source = [F.col(f"`{c}`") if at is None else F.col(f"__{at}_{c}") for c in k.columns]
        nxt = graph.path(k.parent, end)
        need = dict.fromkeys([*k.parent_columns, *(nxt[0].columns if nxt else ())])
        up = tables[k.parent].select(*[F.col(f"`{c}`").alias(f"__{i}_{c}") for c in need])
        df = df.join(up, [a == F.col(f"__{i}_{p}") for a, p in zip(source, k.parent_columns, strict=True)])
        at = i
    total = tables[end].agg(F.count(F.lit(1)).alias("ancestors"))
    return df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(total)).select(F.lit(f"{start}->{end}").alias("path"), "rows", "ancestors", F.try_divide(F.col("rows"), F.col("ancestors")).alias("per_ancestor"))


# DDL

_NAME = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][\w$]*)'
_FAMILIES = (("bool", r"bool|bit"), ("datetime", r"date|time"), ("float", r"float|double|real|num|dec|money"), ("int", r"int|serial"), ("str", r""))


def _bare(name: str) -> str:
    return name.split(".")[-1].strip().strip('"`[]')


def _split(body: str) -> list[str]:
    """The parts of a column list, at commas outside brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(body):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, body[start:]] if p.strip()]


def _columns(text: str) -> tuple[str, ...]:
    return tuple(_bare(c) for c in text.split(","))


def parse_ddl(ddl: str) -> Graph:
    """Tables, keys and foreign keys of CREATE TABLE and ALTER TABLE ... FOREIGN KEY statements."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", ddl, flags=re.S)
    tables: dict[str, Table] = {}
    references: list[tuple[str, tuple[str, ...], str, tuple[str, ...], bool]] = []
    uniques: dict[str, set[tuple[str, ...]]] = {}
    target = rf"references\s+((?:{_NAME}\.)?{_NAME})\s*(?:\(([^)]*)\))?"
    for statement in text.split(";"):
        if m := re.match(rf"\s*create\s+(?:temp\w*\s+)?table\s+(?:if\s+not\s+exists\s+)?((?:{_NAME}\.)?{_NAME})\s*\((.*)\)[^)]*$", statement, re.I | re.S):
            table = Table(_bare(m[1]))
            tables[table.name] = table
            uniques[table.name] = set()
            for part in _split(m[2]):
                rest = re.sub(rf"^constraint\s+{_NAME}\s+", "", part, flags=re.I)
                if k := re.match(r"primary\s+key\s*\(([^)]*)\)", rest, re.I):
                    table.key = _columns(k[1])
                elif k := re.match(r"unique\s*(?:key\s*)?\(([^)]*)\)", rest, re.I):
                    uniques[table.name].add(_columns(k[1]))
                elif k := re.match(rf"foreign\s+key\s*\(([^)]*)\)\s*{target}", rest, re.I):
                    references.append((table.name, _columns(k[1]), _bare(k[2]), _columns(k[3]) if k[3] else (), True))
                elif not re.match(r"(check|index|key|exclude)\b", rest, re.I) and (k := re.match(rf"({_NAME})\s+(\w+)(.*)$", rest, re.I | re.S)):
                    column = _bare(k[1])
                    table.columns[column] = next(f for f, p in _FAMILIES if re.search(p, k[2], re.I))
                    if re.search(r"primary\s+key", k[3], re.I):
                        table.key = (column,)
                    if re.search(r"\bunique\b", k[3], re.I):
                        uniques[table.name].add((column,))
                    if r := re.search(target, k[3], re.I):
                        references.append((table.name, (column,), _bare(r[1]), _columns(r[2]) if r[2] else (), not re.search(r"not\s+null", k[3], re.I)))
        elif m := re.match(rf"\s*alter\s+table\s+(?:only\s+)?((?:{_NAME}\.)?{_NAME})\s+add\s+(?:constraint\s+{_NAME}\s+)?foreign\s+key\s*\(([^)]*)\)\s*{target}", statement, re.I | re.S):
            references.append((_bare(m[1]), _columns(m[2]), _bare(m[3]), _columns(m[4]) if m[4] else (), True))
    graph = Graph(list(tables.values()))
    for child, columns, parent, keys, nullable in references:
        if child not in tables or parent not in tables:
            raise ValueError(f"unknown table {parent if child in tables else child}")
        one = columns in uniques[child] or tables[child].key == columns
        graph.keys.append(ForeignKey(child, columns, parent, keys or tables[parent].key, "1:1" if one else "1:N", nullable, 1.0, "ddl"))
    return graph
