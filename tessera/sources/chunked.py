"""Chunks in and out: a data source of (seed, index) chunks, and one of hashed parts with commit and abort.

``chunks`` is read: its partitions are chunks of row numbers with a seed each, so that rows depend on seed and
number alone. ``hashed_parts`` is written and read: rows with a number ``row`` are dealt by chunk, each chunk is
one part file with its rows, bytes and SHA-256, and a manifest, written last, lists the parts in order. Parts that
no manifest lists do not exist for readers; a task that fails and a write that is aborted take theirs away. The parts,
and so all hashes, are the same for any number of partitions.

Files go through ``pyarrow.fs`` (local shared folders, HDFS, S3). What the driver holds is one small record a chunk.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
import pyarrow.json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.operators import generate

#: Least rows of a chunk and most rows of a run.
LEAST_CHUNK, MOST_ROWS = 100, 100_000_000
MANIFEST = "_parts.json"


def chunk_seed(seed: int, index: int) -> int:
    """31 bits of a hash of both."""
    return int.from_bytes(hashlib.sha256(f"{seed}/{index}".encode()).digest()[:4], "big") >> 1


def plan(rows: int, chunk_rows: int) -> list[tuple[int, int]]:
    """(first row, rows) of each chunk."""
    if not 1 <= rows <= MOST_ROWS:
        raise ValueError(f"rows must be from 1 to {MOST_ROWS}")
    if chunk_rows < LEAST_CHUNK:
        raise ValueError(f"chunks need {LEAST_CHUNK} rows at least")
    return [(a, min(chunk_rows, rows - a)) for a in range(0, rows, chunk_rows)]


@dataclass
class Chunk(InputPartition):
    index: int
    first: int
    rows: int
    seed: int


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.chunks = plan(int(options["rows"]), int(options.get("chunk_rows", 100_000)))
        self.seed, self.start, self.end = int(options.get("seed", 0)), int(options.get("from_chunk", 0)), int(options.get("to_chunk", len(self.chunks)))

    def partitions(self) -> list[InputPartition]:
        return [Chunk(i, first, n, chunk_seed(self.seed, i)) for i, (first, n) in enumerate(self.chunks) if self.start <= i < self.end]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        for at in range(0, partition.rows, 10_000):
            n = min(10_000, partition.rows - at)
            row = pa.array(range(partition.first + at, partition.first + at + n), pa.int64())
            yield pa.RecordBatch.from_arrays([row, pa.array([partition.index] * n, pa.int32()), pa.array([partition.seed] * n, pa.int64())], names=["row", "chunk", "seed"])


class Chunks(DataSource):
    """Options: rows, chunk_rows (100000), seed (0), from_chunk, to_chunk."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return "row long, chunk int, seed long"

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options)


@dataclass
class Part:
    chunk: int
    file: str
    rows: int
    bytes: int
    sha256: str


@dataclass
class Made(WriterCommitMessage):
    parts: list[Part]


def encoded(table: pa.Table, fmt: str) -> bytes:
    """Rows as CSV without a header or as lines of JSON."""
    if fmt == "csv":
        out = io.BytesIO()
        pacsv.write_csv(table, out, pacsv.WriteOptions(include_header=False))
        return out.getvalue()
    return "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for b in table.to_batches() for r in b.to_pylist()).encode()


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.path, self.fmt, self.rows = options["path"].rstrip("/"), options.get("format", "csv"), int(options["chunk_rows"])
        if self.fmt not in {"csv", "jsonl"}:
            raise ValueError(f"parts are csv or jsonl, not {self.fmt}")
        self.names, self.overwrite = names, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Made:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base)
        made: list[Part] = []
        open_part: tuple[int, str, object, object, list[int]] | None = None

        def close() -> None:
            nonlocal open_part
            chunk, name, out, digest, seen = open_part
            out.close()
            made.append(Part(chunk, name, seen[0], seen[1], digest.hexdigest()))
            open_part = None

        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                number = table.column("row").to_numpy() // self.rows
                at = 0
                while at < len(number):
                    end = at + int((number[at:] == number[at]).sum())  # rows come sorted
                    if open_part is not None and open_part[0] != number[at]:
                        close()
                    if open_part is None:
                        # a repeated task writes a file of its own
                        name = f"part-{int(number[at]):08d}-{uuid.uuid4().hex[:12]}.{self.fmt}"
                        open_part = int(number[at]), name, fs.open_output_stream(f"{base}/{name}"), hashlib.sha256(), [0, 0]
                    raw = encoded(table.slice(at, end - at).select([n for n in self.names if n not in ("row", "chunk", "seed")]), self.fmt)
                    open_part[2].write(raw)
                    open_part[3].update(raw)
                    open_part[4][0] += end - at
                    open_part[4][1] += len(raw)
                    at = end
            if open_part is not None:
                close()
        except BaseException:
            if open_part is not None:
                open_part[2].close()
                made.append(Part(open_part[0], open_part[1], 0, 0, ""))
            remove(fs, base, made)
            raise
        return Made(made)

    def commit(self, messages: list[Made | None]) -> None:
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p.chunk)
        if len({p.chunk for p in parts}) < len(parts):
            raise ValueError("a chunk was written twice: deal the rows by chunk")
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base)
        old = listed(self.path)
        kept = [] if self.overwrite else old
        if {p.chunk for p in kept} & {p.chunk for p in parts}:
            raise ValueError("the manifest has some of these chunks already")
        save(self.path, sorted([*kept, *parts], key=lambda p: p.chunk), self.fmt)
        if self.overwrite:
            remove(fs, base, old)

    def abort(self, messages: list[Made | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        remove(fs, base, [p for m in messages if m is not None for p in m.parts])


def remove(fs: pafs.FileSystem, base: str, parts: list[Part]) -> None:
    for p in parts:
        if fs.get_file_info(f"{base}/{p.file}").type == pafs.FileType.File:
            fs.delete_file(f"{base}/{p.file}")


def save(path: str, parts: list[Part], fmt: str) -> None:
    fs, base = pafs.FileSystem.from_uri(path)
    body = {"format": fmt, "rows": sum(p.rows for p in parts), "bytes": sum(p.bytes for p in parts), "sha256": total(parts), "parts": [vars(p) for p in parts]}
    own = f"{base}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(json.dumps(body).encode())
    fs.move(own, f"{base}/{MANIFEST}")


def listed(path: str) -> list[Part]:
    """The parts of a manifest in order; none without one."""
    fs, base = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.File:
        return []
    with fs.open_input_stream(f"{base}/{MANIFEST}") as raw:
        return [Part(**p) for p in json.loads(raw.read())["parts"]]


def total(parts: list[Part]) -> str:
    """One hash of the parts' numbers and hashes."""
    return hashlib.sha256("".join(f"{p.chunk}:{p.sha256}\n" for p in parts).encode()).hexdigest()


@dataclass
class PartFile(InputPartition):
    part: Part


class PartsReader(DataSourceReader):
    """Parts of a manifest as rows; a part whose bytes have another hash raises."""

    def __init__(self, options: dict[str, str], schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.fmt, self.schema = options["path"].rstrip("/"), options.get("format", "csv"), to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        return [PartFile(p) for p in listed(self.path)]

    def read(self, partition: PartFile) -> Iterator[pa.RecordBatch]:
        part = partition.part
        fs, base = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{base}/{part.file}") as source:
            raw = source.read()  # a chunk's rows are bounded
        if hashlib.sha256(raw).hexdigest() != part.sha256:
            raise ValueError(f"{part.file} is not what was written")
        if not raw:
            return
        if self.fmt == "csv":
            table = pacsv.read_csv(io.BytesIO(raw), pacsv.ReadOptions(column_names=self.schema.names), pacsv.ParseOptions(newlines_in_values=True), pacsv.ConvertOptions(column_types=dict(zip(self.schema.names, self.schema.types, strict=True)), strings_can_be_null=True, quoted_strings_can_be_null=False))
        else:
            table = pajson.read_json(io.BytesIO(raw), parse_options=pajson.ParseOptions(explicit_schema=self.schema, newlines_in_values=False))
        yield from table.select(self.schema.names).cast(self.schema).to_batches()


class HashedParts(DataSource):
    """Options: path (a URI in a shared folder), format (csv or jsonl), chunk_rows for writing. Reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "hashed_parts"

    def writer(self, schema: StructType, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options, schema.names, overwrite)

    def reader(self, schema: StructType) -> PartsReader:
        return PartsReader(self.options, schema)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Chunks)
    spark.dataSource.register(HashedParts)
    return spark


def generated(spark: SparkSession, model: generate.Copula, rows: int, chunk_rows: int = 100_000, seed: int = 0, first: int = 0, last: int | None = None) -> DataFrame:
    """``row`` and the model's columns for chunks ``first`` to ``last`` (excluded): a row depends on the seed and its number alone."""
    options = {"rows": rows, "chunk_rows": chunk_rows, "seed": seed, "from_chunk": first} | ({} if last is None else {"to_chunk": last})
    numbers = registered(spark).read.format("chunks").options(**options).load().select("row")
    return generate.sample_given(model, numbers, "row", [], seed)


def written_parts(df: DataFrame, path: str, chunk_rows: int, fmt: str = "csv", append: bool = False, partitions: int | None = None) -> None:
    """Write rows with a number ``row`` as hashed parts: one shuffle by chunk, no more than a chunk's batch held in a task."""
    chunk = F.floor(F.col("row") / chunk_rows)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, chunk).sortWithinPartitions("row")
    registered(df.sparkSession)
    dealt.write.format("hashed_parts").mode("append" if append else "overwrite").option("path", path).option("format", fmt).option("chunk_rows", chunk_rows).save()
