"""Writers: CSV, JSON lines, JSON, SQL dumps, bundles; and loads into SQL databases.

Large tables are written by Spark in parts. ``merged`` gives one file of them in row order, streaming
part after part through the driver.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import sqlite3
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from itertools import islice
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import Graph, family


def visible(df: DataFrame) -> DataFrame:
    """Without hidden columns, whose names begin with an underscore."""
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")])


@dataclass
class ColumnDef:
    name: str
    kind: str
    nullable: bool = True
    max_len: int | None = None
    unique: bool = False


@dataclass
class TableSchema:
    name: str
    columns: list[ColumnDef]
    key: tuple[str, ...] = ()
    references: list[tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=list)


def schema_of(tables: dict[str, DataFrame], graph: Graph | None = None) -> dict[str, TableSchema]:
    """Kinds, nullability and longest texts from one aggregation per table; keys from the graph."""
    out = {}
    for name, df in tables.items():
        df = visible(df)
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"l{i}") for i, c in enumerate(df.columns)]).first()
        key = graph.tables[name].key if graph and name in graph.tables else ()
        cols = [ColumnDef(c, "date" if t == "date" else family(t), row[f"c{i}"] < row["n"] and c not in key, row[f"l{i}"] if family(t) == "str" else None) for i, (c, t) in enumerate(df.dtypes)]
        out[name] = TableSchema(name, cols, key, [(k.columns, k.parent, k.parent_columns) for k in (graph.parents(name) if graph else [])])
    return out


@dataclass(frozen=True)
class Dialect:
    """How one database writes names, types and literals, and what opens and closes a script."""

    types: dict[str, str]
    quote: str = '"'
    booleans: tuple[str, str] = ("TRUE", "FALSE")
    escapes: bool = False  # whether a backslash in a text must be doubled
    opening: tuple[str, ...] = ("BEGIN",)
    closing: tuple[str, ...] = ("COMMIT",)

    def name(self, text: str) -> str:
        return self.quote + text.replace(self.quote, 2 * self.quote) + self.quote

    def names(self, texts: Iterable[str]) -> str:
        return "(" + ", ".join(self.name(t) for t in texts) + ")"

    def type_of(self, c: ColumnDef) -> str:
        """Text is VARCHAR of the next multiple of 16, or TEXT over 255."""
        if c.kind in self.types:
            return self.types[c.kind]
        room = 16 * max(1, ((c.max_len or 0) + 15) // 16)
        return "TEXT" if room > 255 else f"VARCHAR({room})"

    def text(self, c: Column) -> Column:
        """A text column in quotes; NUL is dropped."""
        for found, put in (("\0", ""), *([("\\", "\\\\")] if self.escapes else []), ("'", "''")):
            c = F.replace(c, F.lit(found), F.lit(put))
        return F.concat(F.lit("'"), c, F.lit("'"))

    def value(self, c: Column, kind: str) -> Column:
        """A column as SQL text; NULL for nulls, NaN and infinities."""
        if kind == "bool":
            shown = F.when(c, self.booleans[0]).when(~c, self.booleans[1])
        elif kind in {"int", "float"}:
            shown = F.when(F.abs(c.cast("double")) < float("inf"), c.cast("string"))
        else:
            shown = self.text(c.cast("string"))
        return F.coalesce(shown, F.lit("NULL"))


#: Type names of the databases.
SQL99 = {"int": "BIGINT", "float": "DOUBLE PRECISION", "bool": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP"}
DIALECTS = {
    "ansi": Dialect(SQL99),
    "postgresql": Dialect(SQL99),
    "mysql": Dialect(SQL99 | {"float": "DOUBLE", "bool": "TINYINT(1)", "datetime": "DATETIME"}, "`", ("1", "0"), True, ("SET FOREIGN_KEY_CHECKS = 0", "START TRANSACTION"), ("COMMIT", "SET FOREIGN_KEY_CHECKS = 1")),
    "sqlite": Dialect({"int": "INTEGER", "float": "REAL", "bool": "INTEGER", "date": "TEXT", "datetime": "TEXT"}, booleans=("1", "0")),
}


def literal(c: Column, kind: str, dialect: str) -> Column:
    """A value as SQL text in ``dialect``."""
    return DIALECTS[dialect].value(c, kind)


def table_body(t: TableSchema, d: Dialect) -> Iterator[str]:
    """The clauses of a table's definition: columns, then the key, then references."""
    for c in t.columns:
        rules = [rule for rule, holds in (("NOT NULL", not c.nullable), ("UNIQUE", c.unique)) if holds]
        yield " ".join([d.name(c.name), d.type_of(c), *rules])
    if t.key:
        yield f"PRIMARY KEY {d.names(t.key)}"
    for own, parent, theirs in t.references:
        yield f"FOREIGN KEY {d.names(own)} REFERENCES {d.name(parent)} {d.names(theirs)}"


def definition(t: TableSchema, dialect: str) -> str:
    """The CREATE TABLE statement, without a closing semicolon."""
    d = DIALECTS[dialect]
    return f"CREATE TABLE {d.name(t.name)} (\n    " + ",\n    ".join(table_body(t, d)) + "\n)"


def ordered(schema: dict[str, TableSchema]) -> list[str]:
    """Parents before children."""
    above = {name: {parent for _, parent, _ in t.references} & (schema.keys() - {name}) for name, t in schema.items()}
    try:
        return list(TopologicalSorter(above).static_order())
    except CycleError as why:
        raise ValueError("the tables refer to each other in a cycle") from why


def inserts(df: DataFrame, t: TableSchema, dialect: str, batch: int) -> DataFrame:
    """(v string): INSERT statements of at most ``batch`` rows each, made where the rows are."""
    d = DIALECTS[dialect]
    cells = [d.value(F.col(f"`{c.name}`"), c.kind) for c in t.columns]
    start = f"INSERT INTO {d.name(t.name)} {d.names(c.name for c in t.columns)} VALUES "

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (v for b in batches for v in b.column(0).to_pylist())
        while held := list(islice(rows, batch)):
            yield pa.RecordBatch.from_arrays([pa.array([start + ", ".join(held)])], names=["v"])

    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")")).alias("v")).mapInArrow(joined, "v string")


def sql_dump(tables: dict[str, DataFrame], graph: Graph | None = None, dialect: str = "ansi", batch: int = 500) -> Iterator[str]:
    """A script in one transaction: tables, parents first, then their rows."""
    d, schema = DIALECTS[dialect], schema_of(tables, graph)

    def statements() -> Iterator[str]:
        yield from d.opening
        for n in ordered(schema):
            yield f"DROP TABLE IF EXISTS {d.name(n)}"
            yield definition(schema[n], dialect)
        for n in ordered(schema):
            yield from (r.v for r in inserts(visible(tables[n]), schema[n], dialect, batch).toLocalIterator(prefetchPartitions=True))
        yield from d.closing

    return (s + ";\n" for s in statements())


def csv_lines(df: DataFrame) -> Iterator[str]:
    df = visible(df)
    yield ",".join(_csv(c) for c in df.columns) + "\n"
    cells = [F.coalesce(F.when(F.col(f"`{c}`").cast("string").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]
    for row in df.select(F.concat_ws(",", *cells).alias("v")).toLocalIterator(prefetchPartitions=True):
        yield row["v"] + "\n"


def _csv(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\r\n') else text


def json_lines(df: DataFrame) -> Iterator[str]:
    df = visible(df)
    clean = [F.when(F.isnan(f"`{c}`") | (F.abs(f"`{c}`") == float("inf")), None).otherwise(F.col(f"`{c}`")).alias(c) if t in {"double", "float"} else F.col(f"`{c}`") for c, t in df.dtypes]
    for row in df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator(prefetchPartitions=True):
        yield row["v"] + "\n"


def json_array(df: DataFrame) -> Iterator[str]:
    between = "[\n"
    for line in json_lines(df):
        yield between + line.rstrip("\n")
        between = ",\n"
    yield "\n]\n" if between[0] == "," else "[]\n"


def json_object(tables: dict[str, DataFrame]) -> Iterator[str]:
    """One table as an array; several as an object with an array for each table's name."""
    if len(tables) == 1:
        yield from json_array(_only(tables))
        return
    between = "{"
    for name, df in tables.items():
        yield between + json.dumps(name, ensure_ascii=False) + ": "
        yield from json_array(df)
        between = ","
    yield "}\n" if tables else "{}\n"


EXPORTERS: dict[str, Callable[[dict[str, DataFrame], Graph | None], Iterator[str]]] = {
    "csv": lambda t, g: csv_lines(_only(t)), "jsonl": lambda t, g: json_lines(_only(t)), "json": lambda t, g: json_object(t), "sql": lambda t, g: sql_dump(t, g),
}


def _only(tables: dict[str, DataFrame]) -> DataFrame:
    if len(tables) != 1:
        raise ValueError("this format takes one table; use a bundle for several")
    return next(iter(tables.values()))


def register_exporter(name: str, fn: Callable[[dict[str, DataFrame], Graph | None], Iterator[str]]) -> None:
    EXPORTERS[name] = fn


def exporter(name: str):
    if name not in EXPORTERS:
        raise ValueError(f"unknown format {name}; there are {', '.join(sorted(EXPORTERS))}")
    return EXPORTERS[name]


@dataclass
class Written:
    path: str
    bytes: int
    sha256: str


def merged(parts: Iterable[str], path: str, bom: bool = False, compress: bool = False) -> Written:
    """The parts as one file, hashed while written. Compressed files carry no time stamp."""
    digest, size, done = hashlib.sha256(), 0, Path(path)
    own = done.with_suffix(done.suffix + ".part")
    with own.open("wb") as raw:
        out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") if compress else raw
        for i, part in enumerate(parts):
            data = (("﻿" if bom and not i else "") + part).encode()
            out.write(data)
            digest.update(data)
            size += len(data)
        if compress:
            out.close()
    own.replace(done)
    return Written(str(done), size, digest.hexdigest())


def bundle(tables: dict[str, DataFrame], fmt: str = "csv", graph: Graph | None = None) -> bytes:
    """A zip with one file per table."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            info = zipfile.ZipInfo(f"{name}.{fmt}", (1980, 1, 1, 0, 0, 0))
            z.writestr(info, "".join(exporter(fmt)({name: df}, graph)))
    return held.getvalue()


def write_large(df: DataFrame, path: str, fmt: str = "parquet", compress: str | None = None) -> None:
    """All partitions at once, in Spark's own part files."""
    writer = visible(df).write.mode("overwrite")
    if compress:
        writer = writer.option("compression", compress)
    {"csv": lambda: writer.option("header", True).csv(path), "jsonl": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[fmt]()


# databases

def target(url: str, hosts: tuple[str, ...] = ("localhost", "127.0.0.1"), folder: str | None = None) -> dict:
    """A database URL taken apart; other hosts than the allowed and SQLite files outside ``folder`` are refused."""
    u = urlsplit(url)
    kind = u.scheme.split("+")[0]
    if kind == "sqlite":
        path = Path(u.path.lstrip("/") if not u.path.startswith("//") else u.path[1:]).resolve()
        if folder and not path.is_relative_to(Path(folder).resolve()):
            raise ValueError("the file lies outside the data folder")
        return {"kind": kind, "path": str(path)}
    if kind not in {"postgresql", "mysql"}:
        raise ValueError(f"unknown database {kind}")
    if u.hostname not in hosts:
        raise ValueError(f"host {u.hostname} is not allowed")
    return {"kind": kind, "jdbc": f"jdbc:{kind}://{u.hostname}:{u.port or (5432 if kind == 'postgresql' else 3306)}{u.path}", "user": u.username, "password": u.password}


def masked(url: str) -> str:
    u = urlsplit(url)
    return url.replace(f":{u.password}@", ":***@") if u.password else url


def load_sqlite(tables: dict[str, DataFrame], path: str, graph: Graph | None = None, mode: str = "create", dry_run: bool = False, batch: int = 500) -> dict[str, int]:
    """Load in one transaction and count again; a dry run does all of it and rolls back."""
    if mode not in {"create", "append", "replace"}:
        raise ValueError(f"unknown mode {mode}")
    schema, counts, quoted = schema_of(tables, graph), {}, DIALECTS["sqlite"].name
    con = sqlite3.connect(path, isolation_level=None)
    try:
        con.execute("PRAGMA foreign_keys = ON")
        con.execute("BEGIN")
        names = ordered(schema)
        if mode == "replace":
            for n in reversed(names):
                con.execute(f"DROP TABLE IF EXISTS {quoted(n)}")
        for n in names:
            if mode != "append":
                con.execute(definition(schema[n], "sqlite"))
            cols = schema[n].columns
            plain = [F.col(f"`{c.name}`").cast("int") if c.kind == "bool" else F.col(f"`{c.name}`").cast("string") if c.kind in {"datetime", "date"} else F.col(f"`{c.name}`") for c in cols]
            before = con.execute(f"SELECT count(*) FROM {quoted(n)}").fetchone()[0]
            insert = f"INSERT INTO {quoted(n)} VALUES ({', '.join('?' * len(cols))})"
            sent, held = 0, []
            for row in visible(tables[n]).select(*plain).toLocalIterator():
                held.append(tuple(row))
                if len(held) == batch:
                    con.executemany(insert, held)
                    sent, held = sent + len(held), []
            con.executemany(insert, held)
            sent += len(held)
            after = con.execute(f"SELECT count(*) FROM {quoted(n)}").fetchone()[0]
            if after - before != sent:
                raise RuntimeError(f"{n}: sent {sent} rows, found {after - before}")
            counts[n] = sent
        con.execute("ROLLBACK" if dry_run else "COMMIT")
    except BaseException:
        if con.in_transaction:
            con.execute("ROLLBACK")
        raise
    finally:
        con.close()
    return counts


def load_jdbc(tables: dict[str, DataFrame], url: str, graph: Graph | None = None, mode: str = "append") -> None:
    """Parallel load by Spark; the database's driver must be on the cluster."""
    t = target(url)
    for n in ordered(schema_of(tables, graph)):
        visible(tables[n]).write.jdbc(t["jdbc"], n, mode="overwrite" if mode == "replace" else "append", properties={"user": t["user"] or "", "password": t["password"] or "", "batchsize": "5000"})


def canonical(obj) -> str:
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
