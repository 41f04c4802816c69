"""Documents in chunks, and a packed exchange of fingerprints between them.

``pack`` writes the documents once, a few megabytes of text to a row, so that a chunk has a fixed
name and content that every later pass (and every repeated task) finds again. In a pass, each chunk
sends its distinct fingerprints to the partition of their value range, as one packed block; there the
blocks of all chunks meet, each fingerprint once a chunk however often it occurs, and the answer, a
bit for each fingerprint, is written as one small file per chunk into the shared folder, where the
chunk's next pass reads it. Texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, shared_path, worker, written
from .planes import BYTES, join_planes, split_planes

#: Bytes of text in a chunk, about; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
NULL_ID = -(1 << 63)


#: Bytes of text for each partition of an exchange, about.
PART_BYTES = 256 << 20


def pack(docs: DataFrame, prepare: Callable[[list[bytes]], bytes] | None = None) -> DataFrame:
    """(chunk long, bytes long, rows binary, more binary): ``docs`` (doc_id long, text string, more columns) in chunks.

    ``rows`` is an Arrow stream of the documents in ascending doc_id order, nulls first. ``more`` is what
    ``prepare`` makes of their texts, for passes that need no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 24, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal held, size, seq
            table = pa.Table.from_batches(held)
            table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            more = prepare(texts_of(table)) if prepare else None
            row = pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([more], pa.binary())], names=["chunk", "bytes", "rows", "more"])
            held, size, seq = [], 0, seq + 1
            return row

        import pyarrow.compute  # noqa: F401

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
            start = 0
            ends = np.cumsum(lengths) + size
            while start < batch.num_rows:
                at = int(np.searchsorted(ends, CHUNK_BYTES))
                stop = min(max(at + 1, start + 1), batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size = int(ends[stop - 1])
                start = stop
                if size >= CHUNK_BYTES:
                    ends = ends - size
                    yield chunk()
        if held:
            yield chunk()

    return written(docs.mapInArrow(worker("chunks", run), "chunk long, bytes long, rows binary, more binary"), "chunks")


def parts_of(packed: DataFrame) -> int:
    """Partitions for an exchange between chunks: by the bytes of text, the session's number at least.

    A part then holds what so many bytes of text send, at any size of the table; and a chunk sends a
    block to a part only where it has entries for it, so blocks never outnumber entries.
    """
    size = packed.agg(F.sum("bytes")).first()[0] or 0
    return max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def texts_of(table: pa.Table) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in table.column("text").to_pylist()]


class Chunk:
    """The documents of one packed row, and what was prepared of them."""

    def __init__(self, name: int, rows: bytes, more: bytes | None = None):
        self.name = name
        self.more = more
        self.table = pa.ipc.open_stream(rows).read_all()
        ids = self.table.column("doc_id").combine_chunks()
        self.doc_ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts = texts_of(self.table)
        #: All texts, a blank after each; and where each begins.
        self.blob = b" ".join([*self.texts, b""])
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts])]).astype(np.int64)


def each(chunks: DataFrame, fn: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to every chunk, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows, more = batch.column("chunk"), batch.column("rows"), batch.column("more")
            for i in range(batch.num_rows):
                yield from fn(Chunk(names[i].as_py(), rows[i].as_py(), more[i].as_py()))

    return chunks.mapInArrow(worker("chunks", run), schema)


def each_prepared(chunks: DataFrame, fn: Callable[[int, bytes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to every chunk's name and what was prepared of it; texts are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from fn(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())

    return chunks.select("chunk", "more").mapInArrow(worker("chunks", run), schema)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as byte planes under zstandard."""
    zstd = zstandard.ZstdCompressor(level=1)
    packed = [zstd.compress(p) for p in split_planes(np.ascontiguousarray(values.astype("<u8")), BYTES)]
    return np.array([len(p) for p in packed], "<u4").tobytes() + b"".join(packed)


def unsqueezed(raw: bytes, count: int) -> np.ndarray:
    unzstd, at, planes = zstandard.ZstdDecompressor(), 32, []
    for n in np.frombuffer(raw[:32], "<u4").tolist():
        planes.append(unzstd.decompress(raw[at : at + n]))
        at += n
    return join_planes(planes, count, "<u8", BYTES)


def blocks(name: int, keys: np.ndarray, parts: int, bits: int, *values: np.ndarray) -> pa.RecordBatch:
    """One row for each part: sorted distinct ``keys`` below 2**bits by their value range, with ``values`` beside them."""
    edges = np.searchsorted(keys, (np.arange(1, parts, dtype=object) * (1 << bits) // parts).astype(np.uint64)) if parts > 1 else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], edges, [len(keys)]]).astype(np.int64)
    part, count, data = [], [], [[] for _ in range(1 + len(values))]
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if a == b:
            continue
        part.append(p)
        count.append(int(b - a))
        data[0].append(squeezed(np.diff(keys[a:b], prepend=np.uint64(0))))
        for column, v in zip(data[1:], values, strict=True):
            column.append(squeezed(v[a:b]))
    columns = [pa.array(part, pa.int32()), pa.array([name] * len(part), pa.int64()), pa.array(count, pa.int32()), *(pa.array(d, pa.binary()) for d in data)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "n", *(f"v{i}" for i in range(len(data)))])


BLOCK = "part int, chunk long, n int, v0 binary"


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first places in it, group of each row): rows with equal ``keys`` together, in row order."""
    order = np.argsort(keys[0], kind="stable")
    if len(keys) > 1:
        same = keys[0][order][1:] == keys[0][order][:-1]
        if any((same & (k[order][1:] != k[order][:-1])).any() for k in keys[1:]):
            order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    firsts = np.flatnonzero(new)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, firsts, group


def by_key(answer: Callable[..., np.ndarray]) -> Callable[[list[int], list[int], list[tuple[bytes, ...]]], np.ndarray]:
    """``answer(chunk of each fingerprint, keys, *values)`` as a meeting of key blocks."""

    def meet(names: list[int], counts: list[int], data: list[tuple[bytes, ...]]) -> np.ndarray:
        keys = np.concatenate([np.cumsum(unsqueezed(d[0], n), dtype=np.uint64) for d, n in zip(data, counts, strict=True)])
        values = [np.concatenate([unsqueezed(d[k], n) for d, n in zip(data, counts, strict=True)]) for k in range(1, len(data[0]))]
        return answer(np.repeat(np.array(names, np.int64), counts), keys, *values)

    return meet


def answered(sent: DataFrame, parts: int, meeting: Callable[[list[int], list[int], list[tuple[bytes, ...]]], np.ndarray], label: str, every_bit: bool = False) -> tuple[str, int]:
    """Let the blocks of each part meet; returns the folder with one file of answers per chunk, and the largest answer
    (with ``every_bit``, the bits that any answer has).

    ``meeting(chunks, counts, data)`` gets the blocks of one part, in any order, and returns one
    number from 0 to 255 for each of the entries that the blocks count, in the blocks' order.
    """
    folder = shared_path(sent.sparkSession, label)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, counts, data = None, [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                names.append(batch.column(1)[i].as_py())
                counts.append(batch.column(2)[i].as_py())
                data.append(tuple(batch.column(k)[i].as_py() for k in range(3, batch.num_columns)))
        if part is None:
            return
        marks = meeting(names, counts, data).astype(np.uint8)
        ends = np.cumsum(counts)
        cells = [zstandard.compress(marks[e - n : e].tobytes(), 1) for e, n in zip(ends.tolist(), counts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(cells, pa.binary())], names=["chunk", "part", "marks"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, cells, done, top = None, [], [], []

        def put() -> None:
            own, raw = f"{base}/.{uuid.uuid4().hex}", b"".join(zstandard.decompress(c) for c in cells)
            with fs.open_output_stream(own) as out:
                out.write(raw)
            fs.move(own, f"{base}/{name}")
            done.append(name)
            top.append(int(np.bitwise_or.reduce(np.frombuffer(raw, np.uint8))) if every_bit else max(raw))

        for batch in batches:
            for i in range(batch.num_rows):
                if (chunk := batch.column(0)[i].as_py()) != name:
                    if name is not None:
                        put()
                    name, cells = chunk, []
                cells.append(batch.column(2)[i].as_py())
        if name is not None:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(top, pa.int32())], names=["chunk", "top"])

    marks = sent.repartitionById(parts, F.col("part")).mapInArrow(worker("chunks", meet), "chunk long, part int, marks binary")
    saved = marks.repartition(parts, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(worker("chunks", keep), "chunk long, top int")
    return folder, written(saved, f"{label}-names").agg(F.bit_or("top") if every_bit else F.max("top")).first()[0] or 0


def answers(folder: str, name: int, count: int) -> np.ndarray:
    """The answers for the ``count`` entries that chunk ``name`` sent, in its order."""
    if not count:
        return np.zeros(0, np.uint8)
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/{name}") as source:
        found = np.frombuffer(source.read(), np.uint8)
    if len(found) != count:
        raise RuntimeError(f"chunk {name} sent {count} entries and got {len(found)} answers")
    return found


def mixed(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


BASE = 0x5851F42D4C957F2D
UNBASE = pow(BASE, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}
KEPT["chunks"] = _powers.clear


def powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` of base**0, base**1, ... modulo 2**64; the longest so far is kept."""
    if len(_powers.get(base, ())) < count:
        out = np.full(count + (count >> 3), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:count]


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A random odd-looking 64-bit value for each byte, the same everywhere."""
    return np.random.default_rng(2718).integers(0, 1 << 64, 256, np.uint64)
