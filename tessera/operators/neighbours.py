"""Exact nearest neighbours by an index of pivots and rings.

1. Equal vectors are one entry with the smallest and the largest of their ids, so that copies cost nothing more.
2. A bounded number of vectors are *pivots*; every entry belongs to the cell of its nearest pivot. Entries are
   ranged by cell and distance to the pivot, and stored in blocks: a block is a *ring* around its pivot.
3. Queries are blocked in the same way. Each block of queries meets the ring of its own cell that is closest, which
   with the distances to the pivots bounds every query's answer.
4. By the triangle inequality a ring from low to high around pivot p can hold something within t of q only if
   d(q, p) - t <= high and d(q, p) + t >= low; and the cell of p nothing at all if d(q, p) - d(q, own pivot) > 2 t.
   Blocks of queries go only to rings that one of their queries may need, and in it only those queries are compared.

The vectors of a block are one file in the shared folder (``spark.checkpoint.dir``), written once. What is shuffled are
the names of blocks that meet; a task holds one block of queries and reads the blocks that it meets one after another,
and sends one answer for each of its queries. Disk and shuffle so grow with the rows, not with the pairs.

What is collected or broadcast are the pivots and one row for each cell, at most ``PIVOTS``. Vectors spread evenly in
many dimensions leave few rings out, and every pair of blocks is compared then, as in any exact search.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoints, shared_uri

#: Most pivots, and rows in a block.
PIVOTS, BLOCK = 512, 2_048
#: Most blocks that a block of queries meets in one task, and entries compared at once.
MET, TILE = 256, 1_024

BLOCKS = "block long, cell int, low double, high double, n int, file string"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]) if len(sizes) else 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by products: right within their rounding, see ``slack``."""
    d2 = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """How far ``distances`` may be off."""
    return float(np.sqrt(1e-13 * (a.shape[1] + 4) * ((a**2).sum(1).max(initial=0) + (b**2).sum(1).max(initial=0))))


def finite(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v of the rows that take part: with an id and a vector, all of whose components are finite."""
    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return picked.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))))


def kept(folder: str, first: np.ndarray, last: np.ndarray, gap: np.ndarray, grid: np.ndarray) -> str:
    """The name of a new file of ``folder`` with the entries of one block."""
    fs, base = pafs.FileSystem.from_uri(folder)
    name = uuid.uuid4().hex  # a repeated task writes another file, and only the names of one attempt are read
    with fs.open_output_stream(f"{base}/{name}") as out:
        for part in (first, last, gap, grid):
            out.write(np.ascontiguousarray(part).tobytes())
    return name


def entries_of(folder: str, name: str, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, last, gap, grid of a block."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/{name}") as source:
        raw = source.read()
    ids = np.frombuffer(raw, np.int64, 2 * n)
    return ids[:n], ids[n:], np.frombuffer(raw, np.float64, n, 16 * n), np.frombuffer(raw, np.float64, n * width, 24 * n).reshape(n, width)


def blocked(placed: DataFrame, n: int, size: int, folder: str) -> DataFrame:
    """Blocks, stored in ``folder``, of entries (a, b, v, cell, gap) that are neighbours by cell and gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            gap = table.column("gap").to_numpy()
            name = kept(folder, table.column("a").to_numpy(), table.column("b").to_numpy(), gap, matrix(table.column("v")))
            return pa.RecordBatch.from_arrays([table.column("cell").slice(0, 1).combine_chunks(), pa.array([gap.min()]), pa.array([gap.max()]), pa.array([len(gap)], pa.int32()), pa.array([name])], names=["cell", "low", "high", "n", "file"])

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            cells = table.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            held.clear()
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                while y - x > size or (y - x > 0 and (last or y < len(cells))):
                    yield out(table.slice(x, min(size, y - x)))
                    x = min(y, x + size)
                if x < y:
                    held.extend(table.slice(x, y - x).to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 4 * size:
                    yield from cut(False)
        if held:
            yield from cut(True)

    ranged = placed.repartitionByRange(max(1, -(-n // (4 * size))), "cell", "gap").sortWithinPartitions("cell", "gap")
    made = ranged.mapInArrow(run, BLOCKS.replace("block long, ", "")).withColumn("block", F.monotonically_increasing_id())
    return made.select("block", "cell", "low", "high", "n", "file").checkpoint()


@dataclass
class Index:
    """The entries of one set of rows, blocked around pivots."""

    pivots: np.ndarray
    blocks: DataFrame
    size: int
    n: int
    folder: str

    @staticmethod
    def build(rows: DataFrame, id_col: str, vector: str, size: int = BLOCK, most: int = PIVOTS) -> Index:
        checkpoints(rows.sparkSession)
        entries = finite(rows, id_col, vector).groupBy("v").agg(F.min("id").alias("a"), F.max("id").alias("b")).checkpoint()
        n = entries.count()
        k = max(1, min(most, int(math.sqrt(n))))
        chosen = entries.select("v", F.xxhash64("v", F.lit(5)).alias("h")).orderBy("h", "v").limit(k).collect()
        pivots = matrix(pa.array([r.v for r in chosen], pa.list_(pa.float64()))) if chosen else np.zeros((0, 0))
        folder = shared_uri(rows.sparkSession, "vector-blocks")
        return Index(pivots, blocked(placed(entries, pivots), n, size, folder), size, n, folder)

    def nearest(self, queries: DataFrame, id_col: str, vector: str) -> DataFrame:
        return self.search(queries, id_col, vector)[0]

    def search(self, queries: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, dict[str, int]]:
        """(id, distance, near, single) of each query's nearest row with another id, and how many pairs of blocks there were and were compared.

        ``near`` is the smallest id of the nearest vector's rows (the largest where the smallest is the query's own), and ``single`` whether it has one row only.
        """
        spark, pivots = queries.sparkSession, self.pivots
        asked = finite(queries, id_col, vector).select(F.col("id").alias("a"), F.col("id").alias("b"), "v")
        n = asked.count()
        if not n or not self.n:
            return spark.createDataFrame([], "id long, distance double, near long, single boolean"), {"pairs": 0, "compared": 0}
        mine = blocked(placed(asked, pivots), n, self.size, self.folder)
        sides = self.blocks.select(F.col("block").alias("r_block"), F.struct("n", "file").alias("side"))
        rings = self.blocks.select("block", "cell", "low", "high")
        # the closest ring of the own cell, which is there: a pivot is an entry of its cell
        away = F.greatest(F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"), F.lit(0.0))
        own = mine.select(F.col("block").alias("q"), "cell", F.col("low").alias("q_low"), F.col("high").alias("q_high")).join(rings, "cell")
        home = own.groupBy("q").agg(F.min_by("block", F.struct(away, F.col("block"))).alias("r_block")).checkpoint()
        asking = mine.select(F.col("block").alias("q"), "cell", "n", "file")
        at_home = home.join(sides, "r_block").select("q", F.array(F.struct("side.*", F.lit(None).cast("binary").alias("reach"))).alias("met"))
        first = compared(asking.join(at_home, "q").withColumn("best", F.lit(None).cast("binary")), self.folder, pivots.shape[1]).checkpoint()
        # answers so far, in the order of the blocks' queries, and the rings that may hold better ones
        bounded = asking.join(first.select("q", "best"), "q")
        # few rows of much work: dealt by number
        wanted = bounded.repartition(parallel(spark)).mapInArrow(reaching(pivots, self.folder), "q long, cell int, least double, most double, reach binary")
        met = wanted.alias("w").join(rings, "cell").where((F.col("high") >= F.col("least")) & (F.col("low") <= F.col("most"))).select("q", F.col("block").alias("r_block"), "reach")
        later = met.join(home, ["q", "r_block"], "left_anti").checkpoint()
        # a block of queries meets its blocks in one task, or in as few as keep all tasks at work
        n_mine, n_sides = mine.count(), self.blocks.count()
        shares = max(-(-n_sides // MET), -(-2 * parallel(spark) // n_mine))
        lists = later.join(sides, "r_block").groupBy("q", F.pmod(F.xxhash64("r_block"), F.lit(shares)).alias("share")).agg(F.collect_list(F.struct("side.*", "reach")).alias("met"))
        more = compared(lists.join(bounded, "q"), self.folder, pivots.shape[1])
        found = first.unionByName(more).select(F.inline(F.arrays_zip("id", "distance", "near", "single")))
        best = found.where("distance < double('infinity')").groupBy("id").agg(F.min(F.struct("distance", "near", "single")).alias("m")).select("id", "m.*")
        return best, {"pairs": n_mine * n_sides, "compared": home.count() + later.count()}


def parallel(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)


def placed(entries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``entries`` (v, a, b) with the number of the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grid = matrix(batch.column("v"))
                if grid.shape[1] != pivots.shape[1]:
                    raise ValueError("vectors of different lengths")
                cell = distances(grid, pivots).argmin(1)
                gap = np.sqrt(((grid - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(gap)], names=["a", "b", "v", "cell", "gap"])

    return entries.select("a", "b", "v").mapInArrow(run, "a long, b long, v array<double>, cell int, gap double")


def reaching(pivots: np.ndarray, folder: str):
    """For each block of queries and each cell that one of them may need: the distances to the pivot within which its rings matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, _, own, grid = entries_of(folder, r["file"], r["n"], pivots.shape[1])
                best = np.frombuffer(r["best"])
                to = distances(grid, pivots)
                # a query keeps its answer so far as its bound, widened by what the distances may be off
                reach = best + 2 * slack(grid, pivots) + 1e-12 * (best + own)
                needed = to - own[:, None] <= 2 * reach[:, None]
                cells = np.flatnonzero(needed.any(0))
                least = np.where(needed, to - reach[:, None], np.inf).min(0)[cells]
                most = np.where(needed, to + reach[:, None], -np.inf).max(0)[cells]
                marks = [np.packbits(needed[:, c]).tobytes() for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), r["q"])), pa.array(cells.astype(np.int32)), pa.array(least), pa.array(most), pa.array(marks, pa.binary())], names=["q", "cell", "least", "most", "reach"])

    return run


def compared(groups: DataFrame, folder: str, width: int) -> DataFrame:
    """Each query's nearest entry of the blocks that its block meets: (q, best binary, id, distance, near, single arrays); infinite where there is none.

    ``groups``: q, n and file of a block of queries, ``met`` (n, file and reach of other blocks), and ``best``, distances that need not be looked beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("q", "n", "file", "best", "met")}
                ids, _, _, grid = entries_of(folder, r["file"], r["n"], width)
                norms = (grid**2).sum(1)
                best, near, single = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                bound = best.copy() if r["best"] is None else np.frombuffer(r["best"]).copy()
                for m in r["met"]:
                    some = np.arange(len(ids)) if m["reach"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(m["reach"], np.uint8))[: r["n"]])
                    nearer(ids, grid, norms, some, entries_of(folder, m["file"], m["n"], width), bound, best, near, single)
                lists = [pa.array([x], t) for x, t in ((ids, pa.list_(pa.int64())), (best, pa.list_(pa.float64())), (near, pa.list_(pa.int64())), (single, pa.list_(pa.bool_())))]
                yield pa.RecordBatch.from_arrays([pa.array([r["q"]]), pa.array([best.tobytes()], pa.binary()), *lists], names=["q", "best", "id", "distance", "near", "single"])

    # few rows of much work: dealt by number
    dealt = groups.select("q", "n", "file", "best", "met").repartition(parallel(groups.sparkSession))
    return dealt.mapInArrow(run, "q long, best binary, id array<long>, distance array<double>, near array<long>, single array<boolean>")


def nearer(ids: np.ndarray, grid: np.ndarray, norms: np.ndarray, some: np.ndarray, block: tuple, bound: np.ndarray, best: np.ndarray, near: np.ndarray, single: np.ndarray) -> None:
    """Better ``best``, ``near`` and ``single`` of the queries ``some`` by the entries of ``block``, and ``bound`` with them."""
    a, b, _, other = block
    mine, own, asked = grid[some], norms[some], ids[some]
    for at in range(0, len(other), TILE):
        part, low, high = other[at : at + TILE], a[at : at + TILE], b[at : at + TILE]
        square = (part**2).sum(1)
        # half the squared distances but for the queries' own squares
        halves = square / 2 - mine @ part.T
        # the product only rules entries out: all that may be nearest within its rounding are measured by differences
        slack = 1e-13 * (grid.shape[1] + 4) * (own + square.max(initial=0))
        rows = np.flatnonzero(2 * halves.min(1) + own - slack <= bound[some] ** 2 * (1 + 1e-12))
        if not len(rows):
            continue
        halves = halves[rows]
        alone = (low == high)[None, :] & (asked[rows][:, None] == low[None, :])  # entries of nothing but the query's own id
        halves[alone] = np.inf
        x, y = np.nonzero((halves <= (halves.min(1) + slack[rows])[:, None]) & ~alone)
        if not len(x):
            continue
        x = some[rows[x]]
        exact = np.sqrt(((grid[x] - part[y]) ** 2).sum(1))
        who = np.where(low[y] == ids[x], high[y], low[y])
        order = np.lexsort((who, exact, x))
        lead = order[np.unique(x[order], return_index=True)[1]]
        xs, d, w = x[lead], exact[lead], who[lead]
        better = (d < best[xs]) | ((d == best[xs]) & (w < near[xs]))
        xs, d, w, one = xs[better], d[better], w[better], (low == high)[y[lead]][better]
        best[xs], near[xs], single[xs] = d, w, one
        bound[xs] = np.minimum(bound[xs], d)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, block: int = BLOCK) -> DataFrame:
    """id, distance: exact distance of each query to its nearest row with another id.

    Rows without id or vector take no part, nor do vectors with components that are null or not finite.
    """
    return Index.build(rows, id_col, vector, block).nearest(queries, id_col, vector).select("id", "distance")
