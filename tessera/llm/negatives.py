"""Hard negatives by distributed radix selection over integer inner products.

An anchor's *positives* are its best ``k_positive`` other rows of its own label. For each positive, the hard
negatives are the best ``k_negative`` rows of other labels whose score lies in the anchor-positive window,
from ``share`` percent of the positive's score to that score. Higher scores come first, ties by smaller id.

Selecting the best k rows of a window:

1. Candidates lie in stored blocks. A task scores a block against one block of anchors after the other and
   counts, per window, scores in ``BUCKETS`` equal ranges of the window. Buckets below a block's own kth row
   cannot hold the window's kth row and are left out, so a task sends k counts a window at most.
2. The counts of all blocks, summed, tell the bucket of the kth row. It becomes the window's next range, and so
   digit by digit until the bucket holds ``FEW`` rows or fewer. Where one score alone holds more, the same
   selection goes on over the digits of the ids of its rows, however many share the score.
3. Only rows at or before the bucket found are gathered, k of a block and window at most, and ranked.

Every row meets every anchor, in blocks; what moves between tasks are counts and the rows found. Vectors become
floor(256 x) of each component as doubles; scores are exact: float64 products below 2^53, 64-bit integers below
2^62, Python's integers beyond, where scores that no long holds become the largest or the smallest long.

Rows with a null id, label or vector, or with null or non-finite components take no part. Vectors of different
lengths meet as if the shorter one ended in zeros. Repeated ids are rows of their own; a row with an anchor's id
is none of its positives. An anchor without positives, or a positive without negatives, has no rows. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, worker, written
from .covertree import grid_of, wide

#: Rows in a stored block of candidates and of anchors.
CANDIDATES, ANCHORS = 8192, 256
#: Ranges that a window's scores, or the ids of one score, are counted in at a time.
BUCKETS = 1024
#: A bucket of so many rows is gathered, not refined.
FEW = 64
#: Windows that are compared with a block at once.
WINDOWS = 256

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SCORES, IDS, DONE = 0, 1, 2

#: A block of anchors with its windows: the anchor's place in the block, the score range counted next, what is needed of it,
#: the id range once one score is left, and the last row that qualifies.
ANCHOR_BLOCK = (
    "block long, width int, ids binary, labels binary, grid binary, slot array<int>, top array<long>, lo array<long>, hi array<long>, "
    "need array<int>, phase array<int>, id_lo array<long>, id_hi array<long>, cut array<long>, cut_id array<long>, n_open int"
)
STATE = ("slot", "top", "lo", "hi", "need", "phase", "id_lo", "id_hi", "cut", "cut_id")
ARROW = pa.schema([("block", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("grid", pa.binary()),
                   *[(s, pa.list_(pa.int32() if s in ("slot", "need", "phase") else pa.int64())) for s in STATE], ("n_open", pa.int32())])


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale x) of each component as doubles; null for vectors that take no part. What no double holds becomes the largest one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = float(np.finfo(np.float64).max)

    def floor(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(largest)), F.lit(-largest)))

    return F.when(vector.isNotNull() & ~bad, F.transform(vector, floor))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as longs."""
    width = max(a.shape[1], b.shape[1])
    a, b = wide(a, width), wide(b, width)
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if peak < 2**53:
        return (a @ b.T).astype(np.int64)
    if peak < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    x, y = (np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b))
    return np.clip(x @ y.T, LOWEST, HIGHEST).astype(np.int64)


def apart(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high - low of longs as unsigned numbers, which hold every difference."""
    return high.astype(np.uint64) - low.astype(np.uint64)


def step(low: np.ndarray, high: np.ndarray, buckets: int) -> np.ndarray:
    """The width of each of ``buckets`` ranges that cover low to high."""
    return apart(high, low) // np.uint64(buckets) + np.uint64(1)


def packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """(vec_id, label, v) dealt evenly and stored in blocks of at most ``size`` rows, with the largest norm and the range of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            ids, labels, grid = table.column(0).to_numpy(), table.column(1).to_numpy(), grid_of(table.column(2))
            with np.errstate(over="ignore"):
                norm = float(np.sqrt((grid**2).sum(1)).max())
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, grid)]
            return pa.RecordBatch.from_arrays([*raw, pa.array([grid.shape[1]], pa.int32()), pa.array([norm]), pa.array([ids.min()]), pa.array([ids.max()])], names=["ids", "labels", "grid", "width", "norm", "least_id", "most_id"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if n and n + part.num_rows > size:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.repartition(parts).mapInArrow(worker("negatives", run), "ids binary, labels binary, grid binary, width int, norm double, least_id long, most_id long")


def matrix(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, width)


def record(r: dict, state: dict[str, np.ndarray]) -> pa.RecordBatch:
    """An anchor block with its windows as a row."""
    is_open = int((state["phase"] != DONE).sum())
    values = [r["block"], r["width"], r["ids"], r["labels"], r["grid"], *[state[s] for s in STATE], is_open]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, ARROW, strict=True)], schema=ARROW)


def windows(slot: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, ids: tuple[int, int]) -> dict[str, np.ndarray]:
    """Open windows that need ``k`` rows of scores lo to hi."""
    n = len(slot)
    return {"slot": slot.astype(np.int32), "top": hi, "lo": lo, "hi": hi, "need": np.full(n, k, np.int32), "phase": np.full(n, SCORES, np.int32),
            "id_lo": np.full(n, ids[0], np.int64), "id_hi": np.full(n, ids[1], np.int64), "cut": lo, "cut_id": np.full(n, HIGHEST, np.int64)}


def refined(state: dict[str, np.ndarray], counts: np.ndarray, few: int) -> dict[str, np.ndarray]:
    """The windows after the counts (windows x buckets) of their present ranges are known."""
    s = {k: v.copy() for k, v in state.items()}
    up_to = counts.cumsum(1)
    for w in np.flatnonzero(s["phase"] != DONE).tolist():
        if up_to[w, -1] < s["need"][w]:  # all rows of the window, of which there are fewer than k
            s["phase"][w] = DONE
            continue
        g = int(np.argmax(up_to[w] >= s["need"][w]))
        count = int(counts[w, g])
        s["need"][w] -= int(up_to[w, g]) - count
        by_score = s["phase"][w] == SCORES
        lo, hi = (int(s["lo"][w]), int(s["hi"][w])) if by_score else (int(s["id_lo"][w]), int(s["id_hi"][w]))
        size = (hi - lo) // counts.shape[1] + 1
        if by_score:
            s["lo"][w], s["hi"][w] = max(lo, hi - (g + 1) * size + 1), hi - g * size
            s["cut"][w] = s["lo"][w]
            if count <= max(few, int(s["need"][w])):
                s["phase"][w] = DONE
            elif s["lo"][w] == s["hi"][w]:
                s["phase"][w] = IDS
        else:
            s["id_lo"][w], s["id_hi"][w] = lo + g * size, min(hi, lo + (g + 1) * size - 1)
            s["cut_id"][w] = s["id_hi"][w]
            if count <= max(few, int(s["need"][w])) or s["id_lo"][w] == s["id_hi"][w]:
                s["phase"][w] = DONE
    return s


def swept(candidates: DataFrame, anchors: str, same_label: bool, take: Callable, schema: str, names: list[str], unfinished: bool) -> DataFrame:
    """Each candidate block against all anchor blocks stored in ``anchors``.

    ``take`` gets the anchor block's number, its windows and the numbers of some of them, and for all rows of these
    windows' ranges the window, score and id; it returns the columns ``names``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(anchors)
        stored = pads.dataset(base, filesystem=fs, format="parquet")
        for batch in batches:
            for i in range(batch.num_rows):
                c = {n: batch.column(n)[i].as_py() for n in ("ids", "labels", "grid", "width")}
                ids, labels = np.frombuffer(c["ids"], np.int64), np.frombuffer(c["labels"], np.int64)
                grid = matrix(c["grid"], len(ids), c["width"])
                for part in stored.to_batches(batch_size=8, filter=(pads.field("n_open") > 0) if unfinished else None):
                    for j in range(part.num_rows):
                        yield from met({n: part.column(n)[j] for n in part.schema.names}, ids, labels, grid)

    def met(r: dict, ids: np.ndarray, labels: np.ndarray, grid: np.ndarray) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels = (np.frombuffer(r[n].as_py(), np.int64) for n in ("ids", "labels"))
        state = {s: r[s].values.to_numpy() for s in STATE}
        scores = products(matrix(r["grid"].as_py(), len(a_ids), r["width"].as_py()), grid)
        wanted = np.flatnonzero(state["phase"] != DONE) if unfinished else np.arange(len(state["slot"]))
        for at in range(0, len(wanted), WINDOWS):
            some = wanted[at : at + WINDOWS]
            slot = state["slot"][some]
            s = scores[slot]
            low, high = (state["lo"], state["hi"]) if unfinished else (state["cut"], state["top"])
            good = (s >= low[some, None]) & (s <= high[some, None])
            if same_label:
                good &= (labels[None, :] == a_labels[slot][:, None]) & (ids[None, :] != a_ids[slot][:, None])
            else:
                good &= labels[None, :] != a_labels[slot][:, None]
            w, row = np.nonzero(good)
            if len(w):
                out = take(int(r["block"].as_py()), state, some, w, s[w, row], ids[row])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return candidates.mapInArrow(worker("negatives", run), schema)


def counted(buckets: int) -> Callable:
    """(block, window, bucket, n) of a candidate block: its rows by bucket, as far as they can hold the kth row."""

    def take(block: int, state: dict[str, np.ndarray], some: np.ndarray, w: np.ndarray, score: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        at = some[w]
        by_score = state["phase"][at] == SCORES
        inside = by_score | ((ids >= state["id_lo"][at]) & (ids <= state["id_hi"][at]))
        at, w, score, ids, by_score = at[inside], w[inside], score[inside], ids[inside], by_score[inside]
        far = np.where(by_score, apart(state["hi"][at], score), apart(ids, state["id_lo"][at]))
        width = np.where(by_score, step(state["lo"][at], state["hi"][at], buckets), step(state["id_lo"][at], state["id_hi"][at], buckets))
        bucket = (far // width).astype(np.int64)
        counts = np.bincount(w * buckets + bucket, minlength=len(some) * buckets).reshape(len(some), buckets)
        x, y = np.nonzero((counts > 0) & (counts.cumsum(1) - counts < state["need"][some, None]))
        return [np.full(len(x), block, np.int64), some[x].astype(np.int32), y.astype(np.int32), counts[x, y].astype(np.int64)]

    return take


def gathered(k: int) -> Callable:
    """(block, slot, top, score, vec_id) of a candidate block: its rows down to the cut, the best ``k`` of each window."""

    def take(block: int, state: dict[str, np.ndarray], some: np.ndarray, w: np.ndarray, score: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        at = some[w]
        good = (score > state["cut"][at]) | (ids <= state["cut_id"][at])
        w, score, ids = w[good], score[good], ids[good]
        order = np.lexsort((ids, ~score, w))
        w, score, ids = w[order], score[order], ids[order]
        first = np.searchsorted(w, w, "left")
        best = np.arange(len(w)) - first < k
        at = some[w[best]]
        return [np.full(len(at), block, np.int64), state["slot"][at], state["top"][at], score[best], ids[best]]

    return take


FOUND = "block long, slot int, top long, score long, vec_id long"
COUNTS = "block long, w int, bucket int, n long"


def selected(candidates: DataFrame, anchors: DataFrame, same_label: bool, k: int, buckets: int, few: int) -> DataFrame:
    """(block, slot, top, rank, score, vec_id): the best ``k`` rows of each window of ``anchors``."""
    spark = candidates.sparkSession

    def stored(df: DataFrame) -> tuple[str, DataFrame]:
        path = shared_path(spark, "anchor-blocks")
        df.write.parquet(path)
        return path, spark.read.schema(ANCHOR_BLOCK).parquet(path)

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.slice(0, 1).to_pylist()[0]
        state = {s: left.column(s).combine_chunks()[0].values.to_numpy() for s in STATE}
        counts = np.zeros((len(state["slot"]), buckets), np.int64)
        counts[right.column("w").to_numpy(), right.column("bucket").to_numpy()] = right.column("n").to_numpy()
        return pa.Table.from_batches([record(r, refined(state, counts, few))])

    path, blocks = stored(anchors)
    while blocks.agg(F.sum("n_open")).first()[0]:  # a digit each time: no more than the digits of a score and of an id
        found = swept(candidates, path, same_label, counted(buckets), COUNTS, ["block", "w", "bucket", "n"], True)
        counts = found.groupBy("block", "w", "bucket").agg(F.sum("n").alias("n"))
        path, blocks = stored(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(update, ANCHOR_BLOCK))
    rows = swept(candidates, path, same_label, gathered(k), FOUND, ["block", "slot", "top", "score", "vec_id"], False)
    order = Window.partitionBy("block", "slot", "top").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, share: int = 80, scale: int = 256, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``is_anchor`` holds.

    ``label`` is a whole number, the column ``label`` unless given. ``share`` is in percent, at most 100.
    """
    label = F.col("`label`") if label is None else label
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled(F.col(f"`{vector_col}`"), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = rows.where("v is not null and vec_id is not null and label is not null")
    spark = vectors.sparkSession
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-n // CANDIDATES))
    candidates = written(packed(rows.drop("asked"), CANDIDATES, parts), "candidate-blocks")
    norm, least, most = candidates.agg(F.max("norm"), F.min("least_id"), F.max("most_id")).first()
    ids = (least or 0, most or 0)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grid = matrix(r["grid"], len(r["ids"]) // 8, r["width"])
                with np.errstate(over="ignore", invalid="ignore"):
                    reach = np.nan_to_num(np.sqrt((grid**2).sum(1)) * norm * (1 + 1e-9) + 1, nan=2.0**63, posinf=2.0**63)
                bound = np.array([min(HIGHEST, int(x)) for x in reach.tolist()], np.int64)
                yield record(r, windows(np.arange(len(bound)), -bound - (bound == HIGHEST), bound, k_positive, ids))

    numbered = packed(rows.where("asked").drop("asked"), ANCHORS, max(1, -(-m // ANCHORS))).withColumn("block", F.monotonically_increasing_id())
    anchors = written(numbered.select("block", "width", "ids", "labels", "grid"), "anchors")
    positives = written(selected(candidates, anchors.mapInArrow(worker("negatives", opened), ANCHOR_BLOCK), True, k_positive, BUCKETS, FEW), "positives")

    def between(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.slice(0, 1).to_pylist()[0]
        pairs = np.unique(np.stack([right.column("slot").to_numpy().astype(np.int64), right.column("score").to_numpy()], 1), axis=0)
        slot, score = pairs[:, 0], pairs[:, 1]
        lo = np.array([-(-share * p // 100) for p in score.tolist()], np.int64).reshape(len(score))
        return pa.Table.from_batches([record(r, windows(slot[lo <= score], lo[lo <= score], score[lo <= score], k_negative, ids))])

    bounded = anchors.groupBy("block").cogroup(positives.select("block", "slot", "score").groupBy("block")).applyInArrow(between, ANCHOR_BLOCK)
    negatives = selected(candidates, bounded, False, k_negative, BUCKETS, FEW)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["block", "ids"]).to_pylist():
                own = np.frombuffer(r["ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r["block"])), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["block", "slot", "anchor_id"])

    names = anchors.mapInArrow(worker("negatives", named), "block long, slot int, anchor_id long")
    pairs = positives.select("block", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["block", "slot"])
    found = negatives.select("block", "slot", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["block", "slot", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
