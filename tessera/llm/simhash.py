"""SimHash near-duplicates with pivot distance tables.

1. Fingerprints: one narrow pass; XXH64 of every word shingle, majority of each bit.
2. Distinct fingerprints are dealt into buckets in which every pair within the radius must meet: the
   64 bits are cut into b blocks, and fingerprints that differ in r bits agree on b - r blocks at
   least. b grows with the number of fingerprints, so that buckets stay small.
3. In a bucket, each fingerprint has a row of Hamming distances to reference fingerprints (the
   pivots). Two fingerprints within r bits differ by r at most in every coordinate, so pairs with a
   larger maximum coordinate difference are discarded; survivors are verified bit by bit.
   Large buckets are dealt in chunks to tasks of chunk pairs. A task returns a spanning forest of
   its links, never all pairs.
4. Connected components of the links, in tables.

By similarity (``one_of_each(similarity=...)``), steps 2 to 4 run over fingerprints of 256 bits. So wide a
radius has no small set of blocks in which every pair must meet: buckets are bands of sampled bits, as many
as meet a pair just at the limit with the stated probability. Fingerprints estimate the similarity within some
bits, so candidates are taken ``SPREADS`` deviations beyond the limit and each link is verified on the sets of
shingles themselves. Candidates within one component of verified links need no verification: components grow over
a few rounds, of which the last verifies all candidates between different components.

Null texts count as empty; a text without words has fingerprint zero and links like any other.
Repeated rows each keep their own output row. A component's id is its smallest non-null doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, fresh, keyed, slices, worker, written
from .components import connected

#: Fingerprints in one chunk of a large bucket; a task compares two chunks.
CHUNK = 512
#: A bucket should hold about so many fingerprints at most when fingerprints are spread evenly.
BUCKET = 64
PIVOTS = 32
#: Shingles of a long text whose bits are laid out at once.
PART = 1 << 15
#: 64-bit words of a wide fingerprint; pivots and rows of a chunk for these. At their radius few pivots discard anything.
WORDS, WIDE_PIVOTS, WIDE_CHUNK = 4, 2, 4096
#: Deviations of the estimate by which candidates may lie beyond the limit.
SPREADS = 2.0
#: Candidates of a component that a round verifies; None: all that are left.
ROUNDS = (1, 8, None)


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint (uint64) of each list of 64-bit hashes: bits set in over half of them."""
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    for i in np.flatnonzero(counts > PART):  # a very long text is never all bits at once
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(hashes[i]), PART):
            ones += np.unpackbits(np.array(hashes[i][lo : lo + PART], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > counts[i], bitorder="little").view(np.uint64)[0]
    some = np.flatnonzero((counts > 0) & (counts <= PART))
    if len(some):
        flat = np.concatenate([np.array(hashes[i], np.uint64) for i in some])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        marks = np.packbits(2 * sums > counts[some][:, None], axis=1, bitorder="little")
        out[some] = marks.view(np.uint64).ravel()
    return out


def printer(shingle: int, seed: int) -> Callable[[pa.Array], pa.Array]:
    """A text column -> its fingerprints as longs."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)

    def of(text: str) -> list[int]:
        words = text.encode().lower().split()
        if len(words) <= shingle:
            return [digest(b" ".join(words))] if words else []
        return list(map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))))

    def take(column: pa.Array) -> pa.Array:
        fps = [majority([of(t) for t in texts]) for texts in slices(column, 1_000_000)]
        return pa.array(np.concatenate(fps).view(np.int64))

    return take


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row: ASCII-lower-cased words between ASCII white space."""
    take = printer(shingle, seed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), take(batch.column(1))], names=["doc_id", "fp"])

    return by_batch(keyed(docs, id_col, text_col), run, "doc_id long, fp long", "simhash")


def prints_with(docs: DataFrame, digest: Column, shingle: int, seed: int) -> DataFrame:
    """(doc_id, digest, fp) of every row."""
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    take = printer(shingle, seed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), take(batch.column(1))], names=["doc_id", "digest", "fp"])

    return by_batch(digests, run, "doc_id long, digest long, fp long", "simhash")


def masks(count: int, radius: int) -> list[int]:
    """Bit masks of which any two fingerprints within ``radius`` bits agree on one at least."""
    blocks = radius + 1
    while True:
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
        found = [sum(c) for c in combinations(parts, blocks - radius)]
        if blocks >= radius + 5 or count <= BUCKET << min(m.bit_count() for m in found):
            return [m - (1 << 64) if m >> 63 else m for m in found]
        blocks += 1


def pivots(number: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(number)], np.uint64)


def _keep(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) within ``radius``: by coordinate after coordinate, then bit by bit."""
    for column in table:
        near = np.abs(column[a] - column[b]) <= radius
        a, b = a[near], b[near]
        if not len(a):
            return a, b
    near = np.bitwise_count(prints[:, a] ^ prints[:, b]).sum(axis=0, dtype=np.int32) <= radius
    return a[near], b[near]


def _reached(prints: np.ndarray, table: np.ndarray, start: int, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what pairs within ``radius`` join among ``size`` rows: a row met once is not compared again."""
    rest, found = np.arange(start, start + size), []
    while len(rest):
        waiting, rest = [int(rest[0])], rest[1:]
        while waiting and len(rest):
            row = waiting.pop()
            a, b = _keep(prints, table, np.full(len(rest), row), rest, radius)
            if len(b):
                found.append((a, b))
                waiting += b.tolist()
                rest = np.setdiff1d(rest, b, assume_unique=True)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def links_in(group: np.ndarray, prints: np.ndarray, radius: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs within ``radius`` in each run of ``group`` that join all such pairs; ``prints`` is one row of 64-bit
    words for each word of a fingerprint, as is ``references``."""
    table = np.bitwise_count(prints[:, None, :] ^ references[:, :, None]).sum(axis=0, dtype=np.int16)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(np.repeat(sizes <= 48, sizes))
    for step in range(1, int(sizes[sizes <= 48].max(initial=1))):
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        found.append(_keep(prints, table, rows, rows + step, radius))
    for start, size in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist(), strict=True):
        found.append(_reached(prints, table, start, size, radius))
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return a, b


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is linked to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_links(points: DataFrame, radius: int = 3, words: tuple[str, ...] = ("fp",), cuts: list[list[int]] | None = None, references: np.ndarray | None = None, most: int | None = None, all_found: bool = False) -> DataFrame:
    """(u, v) links, as forests, that join the ``fp`` of every two points within ``radius`` bits that agree on a mask.

    ``words`` name the 64-bit words of a fingerprint; ``cuts`` are masks of one number for each word (by default those
    on one of which every pair within the radius agrees). Buckets beyond ``most`` rows are dealt in chunks.
    ``all_found``: not forests but what was found, which is every pair of a small bucket, and of a larger one each row
    with the rows that it reached first.
    """
    count = points.count()
    cuts = [[m] for m in masks(count, radius)] if cuts is None else cuts
    references = pivots()[None, :] if references is None else references
    most = most or CHUNK
    keys = [[F.col(w).bitwiseAND(F.lit(m).cast("long")) for w, m in zip(words, cut, strict=True) if m] for cut in cuts]
    dealt = points.select("fp", *[w for w in words if w != "fp"], F.posexplode(F.array(*[k[0] if len(words) == 1 else F.xxhash64(*k) for k in keys])).alias("band", "key"))
    sizes = dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    joined = dealt.join(sizes, ["band", "key"], "left")
    chunks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / most).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks).cast("int")
    met = joined.withColumns({"own": own, "chunks": chunks}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other"))
    tasks = met.select(group.alias("g"), "fp", *[w for w in words if w != "fp"])
    first = 1 if len(words) == 1 else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            a, b = links_in(rows[0], rows[first:].view(np.uint64), radius, references)
            if all_found:
                return pa.RecordBatch.from_arrays([pa.array(rows[1][a]), pa.array(rows[1][b])], names=["u", "v"])
            root = forest(rows.shape[1], a, b)
            child = np.flatnonzero(root != np.arange(rows.shape[1]))
            u, v = rows[1][child], rows[1][root[child]]
            differ = u != v
            return pa.RecordBatch.from_arrays([pa.array(u[differ]), pa.array(v[differ])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= 16_384:
                rows = np.concatenate(held, axis=1)
                last = int(np.searchsorted(rows[0], rows[0, -1]))  # the last group may go on
                if last:
                    yield solve(np.ascontiguousarray(rows[:, :last]))
                held, size = [rows[:, last:]], rows.shape[1] - last
        if size:
            yield solve(np.concatenate(held, axis=1))

    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * len(cuts) // 200_000)
    return tasks.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(worker("simhash", run), "u long, v long")


def roots_of(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for every distinct ``fp``: root is the smallest fingerprint of its component."""
    points = written(prints.select("fp").distinct(), "points")
    joined = written(connected(near_links(points, radius)), "components")
    return points.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    rooted = points.join(roots_of(prints, radius), "fp")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_printer(shingle: int, seed: int) -> Callable[[pa.Array], list[pa.Array]]:
    """A text column -> the WORDS words of its fingerprints of 64 * WORDS bits, as longs, and a hash of its set of shingles."""
    digests = [partial(xxhash.xxh3_128_digest, seed=seed + i) for i in range(WORDS // 2)]

    def of(text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(WORDS + 1, np.uint64)
        seen = []
        number = max(1, len(words) - shingle + 1)
        ones = np.zeros(64 * WORDS, np.int64)
        for lo in range(0, number, 1 << 15):  # a very long text is never all bits at once
            part = words[lo : lo + (1 << 15) + shingle - 1]
            pieces = [b" ".join(part)] if number == 1 else list(map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)))
            raw = np.hstack([np.frombuffer(b"".join(map(d, pieces)), np.uint8).reshape(-1, 16) for d in digests])
            seen.append(np.unique(np.ascontiguousarray(raw[:, :8]).view(np.uint64)))
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        members = seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))
        return np.r_[np.packbits(2 * ones > number, bitorder="little").view(np.uint64), np.uint64(xxhash.xxh64_intdigest(members.tobytes()))]

    def take(column: pa.Array) -> list[pa.Array]:
        prints = np.stack([of(t) for texts in slices(column, 1_000_000) for t in texts]).view(np.int64)
        return [pa.array(np.ascontiguousarray(w)) for w in prints.T]

    return take


def shingle_set(text: str, shingle: int, seed: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, the whole sequence where it has fewer words."""
    words = text.encode().lower().split()
    pieces = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in pieces), np.uint64)) if words else np.zeros(0, np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (u, v) with ``good``: whether the sets of shingles of both have that similarity (Jaccard). ``sets``: fp, members."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
            good.append(both >= similarity * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["u", "v", "good"])

    sides = [sets.select(F.col("fp").alias(n), F.col("members").alias(f"{n}_members")) for n in ("u", "v")]
    met = pairs.select("u", "v").join(sides[0], "u").join(sides[1], "v").select("u", "v", "u_members", "v_members")
    return by_batch(met, run, "u long, v long, good boolean", "simhash")


def similar_groups(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components that the candidate pairs (u, v) of at least that similarity join.

    Of a component's candidates to others a round verifies a few, the last round all that are left: candidates that
    earlier links have joined anyway are never compared, and no link between different texts is lost.
    """
    links: DataFrame | None = None
    roots: DataFrame | None = None
    left = candidates
    for most in ROUNDS:
        if roots is not None:
            own, other = (roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in ("u", "v"))
            left = left.join(own, "u", "left").join(other, "v", "left").select("u", "v", F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b")).where("a <> b")
        else:
            left = left.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b"))
        left = written(left, "open-pairs")
        picked = left
        if most is not None:
            order = Window.partitionBy(F.greatest("a", "b")).orderBy(F.least("a", "b"), "u", "v")
            picked = left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
        tried = written(verified(picked, sets, similarity), "verified")
        good = tried.where("good").select("u", "v")
        links = good if links is None else links.unionByName(good)
        roots = written(connected(links), "components")
        left = left.select("u", "v").join(tried.select("u", "v"), ["u", "v"], "left_anti")
    return roots


def differing(similarity: float) -> int:
    """Bits of a wide fingerprint in which texts of that similarity (Jaccard, of shingles) differ on average."""
    return round(64 * WORDS * acos(2 * similarity / (1 + similarity)) / pi)


def bands(count: int, radius: int, recall: float, seed: int = 1) -> list[list[int]]:
    """Masks of as many bits as keep buckets of ``count`` spread fingerprints small, and so many masks that two
    fingerprints ``radius`` bits apart agree on one with probability ``recall`` (closer ones with more)."""
    width = 64 * WORDS
    bits = max(8, (max(count, 1) - 1).bit_length() - 4)
    agree = comb(width - radius, bits) / comb(width, bits)
    number = ceil(log(1 - recall) / log(1 - agree))
    rng = np.random.default_rng(seed)
    drawn = np.concatenate([rng.permutation(width)[: width // bits * bits].reshape(-1, bits) for _ in range(ceil(number / (width // bits)))])[:number]
    out = np.zeros((number, width), np.uint8)
    np.put_along_axis(out, drawn, 1, axis=1)
    return np.packbits(out, axis=1, bitorder="little").view(np.int64).tolist()


def wide_groups(docs: DataFrame, digest: Column, shingle: int, similarity: float, recall: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, w0, ...) of every row, and (doc_id, digest): the smallest of each component of texts whose
    sets of shingles have ``similarity`` or more."""
    take, words = wide_printer(shingle, seed), tuple(f"w{i}" for i in range(WORDS))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *take(batch.column(1))], names=["doc_id", "digest", *words, "members_hash"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    rows = written(by_batch(texts, run, "doc_id long, digest long, " + ", ".join(f"{w} long" for w in words) + ", members_hash long", "simhash"), "fingerprints")
    # texts of equal sets are one point; numbers are given once, then read: repeated tasks see the same ones
    points = rows.groupBy(*words, "members_hash").agg(F.min(F.struct("doc_id", "digest")).alias("k"))
    points = written(points.withColumn("fp", F.monotonically_increasing_id()), "points")
    radius = differing(similarity)
    beyond = radius + ceil(SPREADS * (radius * (1 - radius / (64 * WORDS))) ** 0.5)
    references = np.stack([pivots(WORDS * WIDE_PIVOTS)[i::WORDS] for i in range(WORDS)])
    near = near_links(points.select("fp", *words), beyond, words, bands(points.count(), radius, recall), references, WIDE_CHUNK, all_found=True)
    candidates = written(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "candidates")
    nodes = candidates.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(points.select("fp", "k"), "fp").select("fp", F.col("k.doc_id").alias("id"), F.col("k.digest").alias("of"))
    asked = texts.join(nodes, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).select("fp", "text").dropDuplicates(["fp"])

    def members(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, shingle, seed).tobytes() for part in slices(batch.column(1)) for t in part]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["fp", "members"])

    sets = written(by_batch(asked, members, "fp long, members binary", "simhash"), "shingle-sets")
    joined = similar_groups(candidates, sets, similarity).withColumnRenamed("node", "fp")
    roots = points.select("fp", "k").join(joined, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    return rows, roots.agg(F.min("k").alias("k")).select("k.doc_id", "k.digest")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, similarity: float | None = None, recall: float = 0.95) -> DataFrame:
    """``docs`` (doc_id, text, more columns) with one row of each component: that of the smallest
    (doc_id, hash of text), nulls first. Rows of equal id and text are one document and keep one row.

    With ``similarity``, texts are linked not by ``radius`` of 64 bits but where their sets of shingles have that
    similarity (Jaccard) or more. Wide fingerprints bring candidates together, a pair that they estimate just at the
    limit with probability ``recall``; every link is verified on the sets.
    """
    doc_id, digest = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own, kept_id, kept_digest = fresh(docs, "own_digest", "kept_id", "kept_digest")
    if similarity is None:
        # the fingerprint decides the component, so (doc_id, digest) -> fingerprint -> component is one lookup
        rows = written(prints_with(docs, digest, shingle, seed), "fingerprints")
        roots = written(roots_of(rows, radius), "roots")
        named = rows.join(roots, "fp").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("k")).select("k.doc_id", "k.digest")
    else:
        rows, named = wide_groups(docs, digest, shingle, similarity, recall, seed)
    keep = named.select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
    left = docs.withColumn(own, digest).join(keep, doc_id.eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)), "left_semi")
    if rows.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
