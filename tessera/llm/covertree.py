"""Exact top-k inner-product search with dual cover trees.

1. Every vector goes to the nearest of a bounded number of pivots, sampled from the vectors. Vectors of
   one pivot make blocks of bounded size, candidates and queries apart; each block is written once, with
   its cover tree, centre and covering radius.
2. Each query block meets one candidate block of its own pivot: the kth scores found there are first
   lower bounds.
3. A pair of blocks is discarded when the largest score that their centres and radii allow is below the
   worst of the query block's bounds. The remaining pairs are one piece of work each: both trees are
   descended together, and a pair of nodes is discarded likewise, against the worst kth score of the
   query node's queries.
4. A window per query takes the best of what all its pairs returned, k rows each at most.

Vectors become floor(1024 x) of each component. Scores are exact: float64 products below 2^53, 64-bit
integers below 2^62, Python's integers beyond; scores that no long holds become the largest or the
smallest long. Null vectors and vectors with null or non-finite components take no part. Vectors of
different lengths meet as if the shorter one ended in zeros. Repeated ids are rows of their own; a
query's own id is never its answer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, worker, written

#: Most vectors that others are dealt by.
PIVOTS = 128
#: Rows in a block of candidates and of queries, about.
CANDIDATES, QUERIES = 4096, 1024
#: Pairs of blocks in a task, about.
PAIRS = 16
#: Points in a leaf node.
LEAF = 24


@dataclass
class Node:
    """``points`` lie within ``radius`` of row ``centre``; an inner node's children part them."""

    centre: int
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(rows: np.ndarray) -> Node:
    """A cover tree of the rows of a float64 matrix, built from the top.

    A node's children are a net of its points at half its radius: each child's centre is farther
    than that from the centres before it, and takes the points within it that are still free.
    """

    def build(centre: int, points: np.ndarray, gaps: np.ndarray) -> Node:
        node = Node(centre, float(gaps.max(initial=0.0)), points)
        if len(points) <= LEAF or node.radius == 0 or not np.isfinite(node.radius):
            return node
        limit = node.radius / 2
        free, near = points, gaps
        at = centre
        while len(free):
            taken = near <= limit
            mine = free[taken]
            node.children.append(build(at, mine, near[taken]))
            free = free[~taken]
            if len(free):
                at = int(free[0])
                near = np.sqrt(((rows[free] - rows[at]) ** 2).sum(1))
                if len(node.children) >= 256:  # no net to speak of: the rest is one child
                    node.children.append(Node(at, float(near.max()), free))
                    break
        return node

    everything = np.arange(len(rows))
    return build(0, everything, np.sqrt(((rows - rows[0]) ** 2).sum(1)))


#: Scores of no row, below all others.
NONE = np.iinfo(np.int64).min


def bounded(reach: np.ndarray) -> np.ndarray:
    """Upper bounds of scores, which longs saturate: none is below the smallest score, and what overflows in doubles bounds nothing."""
    return np.maximum(np.nan_to_num(reach, nan=np.inf, posinf=np.inf, neginf=-np.inf), float(NONE + 2))


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, q_tree: Node | None = None, r_tree: Node | None = None, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the best ``k`` rows for each query, ties to smaller ids; a query's own id is left out.

    Scores below a query's ``least`` need not be found. A given ``r_tree`` is that of ``rows`` in the order of ``ids``.
    """
    width = max(queries.shape[1], rows.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    order = np.argsort(ids, kind="stable")  # smaller ids at smaller rows: ties are settled by row
    rows, ids = rows[order], ids[order]
    peak = max(1.0, float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, width))
    exact = peak < 2**53
    if not len(queries) or not len(rows):
        return [(ids[:0], np.zeros(0, np.int64)) for _ in queries]
    q_tree, r_tree = q_tree or cover_tree(queries), r_tree or cover_tree(rows)
    least = np.full(len(queries), NONE + 1, np.int64) if least is None else least
    norms_q, norms_r = np.sqrt((queries**2).sum(1)), np.sqrt((rows**2).sum(1))
    if not exact:
        whole_numbers = np.int64 if peak < 2**62 else object
        q_int, r_int = ((x.astype(np.int64) if whole_numbers is np.int64 else np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)) for x in (queries, rows))
    best_s = np.full((len(queries), k), NONE + 1, np.int64)
    best_r = np.full((len(queries), k), len(rows), np.int64)
    slack = 1 + 1e-9 * peak

    def floor_of(points: np.ndarray) -> float:
        return float(np.maximum(best_s[points, -1], least[points]).min())

    kids: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def children(node: Node) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii of a node's children."""
        if id(node) not in kids:
            kids[id(node)] = np.array([c.centre for c in node.children]), np.array([c.radius for c in node.children])
        return kids[id(node)]

    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def members(node: Node) -> tuple[np.ndarray, np.ndarray]:
        """The points of a node's children, one child after another, and where each begins."""
        if id(node) not in parts:
            sizes = [len(c.points) for c in node.children]
            parts[id(node)] = np.concatenate([c.points for c in node.children]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        return parts[id(node)]

    def leaves(q: Node, r: Node) -> None:
        scores = queries[q.points] @ rows[r.points].T if exact else q_int[q.points] @ r_int[r.points].T
        if not exact and whole_numbers is object:
            scores = np.clip(scores, NONE + 2, np.iinfo(np.int64).max)
        scores = scores.astype(np.int64)
        same = query_ids[q.points][:, None] == ids[r.points][None, :]
        scores[same] = NONE
        hot = np.flatnonzero((scores >= np.maximum(best_s[q.points, -1], least[q.points])[:, None]).any(1))
        if not len(hot):
            return
        at = q.points[hot]
        s = np.concatenate([best_s[at], scores[hot]], axis=1)
        w = np.concatenate([best_r[at], np.broadcast_to(np.where(same[hot], len(rows), r.points[None, :]), (len(hot), len(r.points)))], axis=1)
        rank = np.lexsort((w, ~s), axis=1)[:, :k]  # ~s falls as s grows, without overflow
        best_s[at], best_r[at] = np.take_along_axis(s, rank, 1), np.take_along_axis(w, rank, 1)

    def descend(q: Node, r: Node) -> None:
        if not q.children and not r.children:
            leaves(q, r)
            return
        if r.children and (not q.children or r.radius >= q.radius):
            centres, radii = children(r)
            reach = bounded(rows[centres] @ queries[q.centre] + norms_q[q.centre] * radii + (norms_r[centres] + radii) * q.radius + slack)
            floor = floor_of(q.points)
            for i in np.argsort(-reach, kind="stable").tolist():
                if reach[i] < floor:  # and so are all that follow
                    break
                descend(q, r.children[i])
                floor = floor_of(q.points)
        else:
            centres, radii = children(q)
            reach = bounded(queries[centres] @ rows[r.centre] + norms_r[r.centre] * radii + (norms_q[centres] + radii) * r.radius + slack)
            # the children part the queries, so that no descent changes the floor of another child
            points, starts = members(q)
            floors = np.minimum.reduceat(np.maximum(best_s[points, -1], least[points]), starts)
            for i in np.flatnonzero(reach >= floors).tolist():
                descend(q.children[i], r)

    with np.errstate(over="ignore", invalid="ignore"):
        descend(q_tree, r_tree)
    out = []
    for s, w, floor in zip(best_s, best_r, least, strict=True):
        real = (w < len(rows)) & (s >= floor)
        out.append((ids[w[real]], s[real]))
    return out


def whole(vector: Column) -> Column:
    """floor(1024 x) of each component as doubles, which hold it exactly (beyond them the largest one); null for vectors that take no part."""
    largest = float(np.finfo(np.float64).max)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def floor(x: Column) -> Column:
        y = 1024 * x.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(largest)), F.lit(-largest)))  # larger doubles are whole

    return F.when(vector.isNotNull() & ~bad, F.transform(vector, floor))


def grid_of(v: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as a matrix of ``width`` columns at least, shorter rows ended by zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = np.diff(v.offsets.to_numpy())
    grid = np.zeros((len(v), max(width, int(sizes.max(initial=0)))))
    grid[np.arange(grid.shape[1])[None, :] < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return grid


def wide(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, [(0, 0)] * (a.ndim - 1) + [(0, width - a.shape[-1])])


BLOCK = "block long, pivot int, ids binary, grid binary, width int, tree binary, centre array<double>, radius double"


def blocks(placed: DataFrame, size: int, counts: dict[int, int]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``placed`` (vec_id, v, pivot) in stored blocks of about ``size`` rows, and each pivot's (first block, number of blocks)."""
    ranges: dict[int, tuple[int, int]] = {}
    at = 0
    for pivot in sorted(counts):
        ranges[pivot] = at, -(-counts[pivot] // size)
        at += ranges[pivot][1]
    firsts, numbers = (F.array(*[F.lit(ranges.get(p, (0, 1))[i]).cast("long") for p in range(max(counts, default=0) + 1)]) for i in (0, 1))
    place = F.col("pivot") + 1
    number = F.element_at(firsts, place) + F.pmod(F.xxhash64("vec_id", "v"), F.element_at(numbers, place))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        grid = grid_of(table.column("v"))[order]
        tree = cover_tree(grid)
        return pa.table({
            "block": table.column("block")[:1], "pivot": table.column("pivot")[:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "grid": pa.array([grid.tobytes()], pa.binary()),
            "width": pa.array([grid.shape[1]], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "centre": pa.array([grid[tree.centre].tolist()], pa.list_(pa.float64())), "radius": pa.array([tree.radius], pa.float64()),
        })

    return written(placed.withColumn("block", number).groupBy("block").applyInArrow(build, BLOCK), "vector-blocks"), ranges


def solved(pairs: DataFrame, k: int) -> DataFrame:
    """(a, least binary, query_id, vec_id, score arrays): each pair's best rows and the bounds they leave, query by query.

    ``pairs``: the columns of a query block, of a candidate block with the prefix c_, and ``least`` (binary or null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                q_ids, ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                q, c = np.frombuffer(r["grid"]).reshape(len(q_ids), r["width"]), np.frombuffer(r["c_grid"]).reshape(len(ids), r["c_width"])
                least = None if r["least"] is None else np.frombuffer(r["least"], np.int64)
                found = search(q, q_ids, c, ids, k, pickle.loads(r["tree"]), pickle.loads(r["c_tree"]), least)
                floor = np.array([f[1][-1] if len(f[1]) == k else NONE + 1 for f in found], np.int64)
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["block"]], pa.int64()), pa.array([floor.tobytes()], pa.binary()), pa.array([np.repeat(q_ids, sizes)], pa.list_(pa.int64())),
                    pa.array([np.concatenate([f[0] for f in found])], pa.list_(pa.int64())), pa.array([np.concatenate([f[1] for f in found])], pa.list_(pa.int64())),
                ], names=["a", "least", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(worker("covertree", run), "a long, least binary, query_id array<long>, vec_id array<long>, score array<long>")


def reachable(candidates: DataFrame, metas: str) -> DataFrame:
    """(a, b): the pairs of query and candidate blocks whose centres and radii allow a score that still counts.

    ``metas`` is a Parquet folder (a, home, centre, radius, floor) of the query blocks, read in batches by each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(metas)
        for batch in batches:
            if not batch.num_rows:
                continue
            b, radius = batch.column("block").to_numpy(), batch.column("radius").to_numpy()
            centre = grid_of(batch.column("centre"))
            for part in pads.dataset(base, filesystem=fs, format="parquet").to_batches(batch_size=4096):
                if not part.num_rows:
                    continue
                other = grid_of(part.column("centre"), centre.shape[1])
                mine = wide(centre, other.shape[1])
                norm, norm_q, reach_q = np.sqrt((mine**2).sum(1)), np.sqrt((other**2).sum(1)), part.column("radius").to_numpy()
                most = (norm_q + reach_q)[:, None] * (norm + radius)[None, :]
                bound = other @ mine.T + norm_q[:, None] * radius[None, :] + reach_q[:, None] * norm[None, :] + reach_q[:, None] * radius[None, :] + 1 + 1e-9 * most
                # scores beyond 2^63 count as the largest long
                near = (np.minimum(bounded(bound), 2.0**63) >= part.column("floor").to_numpy().astype(np.float64)[:, None] * (1 - 1e-15) - 1) & (part.column("home").to_numpy()[:, None] != b[None, :])
                x, y = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(part.column("a").to_numpy()[x]), pa.array(b[y])], names=["a", "b"])

    return candidates.select("block", "centre", "radius").mapInArrow(worker("covertree", run), "a long, b long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The best ``k`` other rows for every row for which ``is_query`` holds: query_id, rank, vec_id, score."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole(F.col(f"`{vector_col}`")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where("v is not null and vec_id is not null")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    most = max(1, min(PIVOTS, n // CANDIDATES, m // max(1, QUERIES // 4)))  # so that blocks of few vectors are not many
    pivots = [r.v for r in rows.select("v", F.xxhash64("vec_id", F.lit(9)).alias("h"), "vec_id").orderBy("h", "vec_id").limit(most).collect()]
    table = grid_of(pa.array(pivots or [[]], pa.list_(pa.float64())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = grid_of(batch.column("v"), table.shape[1])
            near = wide(table, grid.shape[1])
            pivot = ((near**2).sum(1)[None, :] - 2 * (grid @ near.T)).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=["vec_id", "v", "q", "pivot"])

    placed = written(rows.mapInArrow(worker("covertree", place), "vec_id long, v array<double>, q boolean, pivot int"), "placed-vectors")
    sizes = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m")).collect()  # one row per pivot
    candidates, ranges = blocks(placed, CANDIDATES, {r.pivot: r.n for r in sizes})
    queries, q_ranges = blocks(placed.where("q"), QUERIES, {r.pivot: r.m for r in sizes if r.m})
    side = candidates.select(*[F.col(c).alias(f"c_{c}") for c in ("block", "ids", "grid", "width", "tree")])
    # a query block's home: one of the candidate blocks of its pivot, which has one, as queries are candidates too
    # pairs are few rows of much work: they are dealt by number, not by size
    tasks = lambda pairs: max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS)
    firsts, numbers = (F.array(*[F.lit(ranges.get(p, (0, 1))[i]).cast("long") for p in range(max(ranges, default=0) + 1)]) for i in (0, 1))
    homed = queries.withColumn("home", F.element_at(firsts, F.col("pivot") + 1) + F.pmod("block", F.element_at(numbers, F.col("pivot") + 1)))
    at_home = homed.withColumn("least", F.lit(None).cast("binary")).join(side, F.col("home") == F.col("c_block")).drop("c_block")
    first = written(solved(at_home.repartition(tasks(sum(n for _, n in q_ranges.values())), "block"), k), "first-scores")
    floors = first.select(F.col("a").alias("block"), "least")
    bounded = homed.join(floors, "block")

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = [int(np.frombuffer(x, np.int64).min()) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(floor, pa.int64())], names=["a", "home", "centre", "radius", "floor"])

    path = shared_path(vectors.sparkSession, "query-blocks")
    bounded.select("block", "home", "centre", "radius", "least").mapInArrow(worker("covertree", worst), "a long, home long, centre array<double>, radius double, floor long").write.parquet(path)
    pairs = written(reachable(candidates, path), "block-pairs")
    met = pairs.join(bounded.drop("centre", "radius", "pivot", "home"), F.col("a") == F.col("block")).drop("a").join(side, F.col("b") == F.col("c_block")).drop("c_block")
    found = first.unionByName(solved(met.repartition(tasks(pairs.count()), "block", "b").drop("b"), k)).select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("f")).select("f.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
