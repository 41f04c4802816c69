"""Suffix-array dedup by deep-shallow sorting.

Which strings of ``length`` bytes start in more than one place? Two equal strings agree on every
sub-string, so on their smallest hashed sub-string of K bytes as well: their anchor, at the same place
in both. Strings therefore need comparing only under one anchor, and the suffixes to sort are those
that begin at anchors. Consecutive starts with the same anchor are one stretch.

1. ``pack`` cuts every chunk into stretches, once.
2. A census counts the stretches of each anchor. An anchor that occurs once holds nothing repeated.
3. The stretches of all other anchors are sent to the partition of the anchor, equal ones of a chunk
   once with their number. There the anchor suffixes are sorted deep-shallow: multikey quicksort to
   the anchor's K bytes, then blind tries order the groups that still agree, both to the right of the
   anchor and, reversed, to its left. Cut at every depth, the two orders tell which strings of
   ``length`` bytes around the anchor are equal. What is removed comes from these orders alone: hashes
   only say where suffixes meet, never that they are equal.
4. Hot anchors. Where very many different stretches share an anchor, their starts are cut again under
   anchors of twice the bytes, up to ``length``, where a group holds equal strings only. Where very
   many chunks share an anchor, they meet in several groups, and one stretch of each kind goes on
   from every group to the next round. No group is unbounded, and none is left out.

Bytes covered by a repeated string go. Null texts count as empty; matches never cross documents;
repeated rows are copies of each other; a null doc_id is a document like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as ch

#: Bytes of an anchor of the first level.
K = 96
#: Most different stretches that are sorted under one anchor; with more, its starts get deeper anchors.
GROUP = 2048
#: Answers of the census, and above them log2 of the number of groups of a split anchor.
AGAIN, HOT, GROUPS = 1, 2, 4
#: Answers of the sort for each start; a survivor is the first stretch of its kind in the group.
REPEATED, SURVIVOR = 1, 2
#: Rounds after which the work must be done: levels of anchors, and splits by a factor of eight.
ROUNDS = 24


def anchors(raw: bytes, length: int, k: int = K) -> np.ndarray:
    """For each start of a string of ``length`` bytes, the place of its anchor (the leftmost of equal ones)."""
    if len(raw) < length:
        return np.zeros(0, np.int64)
    h = ch.byte_values()[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    have = 1
    while have < k:
        step = min(have, k - have)
        h = h[:-step] * np.uint32(0x9E3779B1) + h[step:] * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE3D)
        have += step
    low = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    have, span = 1, length - k + 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Stretches:
    """Stretches of a chunk: row, first start, number of starts, anchor place and bytes, and the hashes of both."""

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    place: np.ndarray
    depth: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray

    KINDS = ("<u4", "<u4", "<u4", "<u4", "<u4", "<u8", "<u8")

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.row, self.first, self.count, self.place, self.depth, self.anchor, self.whole

    def take(self, at: np.ndarray) -> Stretches:
        return Stretches(*(c[at] for c in self.columns()))

    def plus(self, other: Stretches) -> Stretches:
        return Stretches(*(np.concatenate(p) for p in zip(self.columns(), other.columns(), strict=True)))

    def packed(self) -> bytes:
        raw = b"".join(np.ascontiguousarray(c.astype(k)).tobytes() for c, k in zip(self.columns(), self.KINDS, strict=True))
        return len(self.row).to_bytes(4, "little") + zstandard.compress(raw, 1)

    @classmethod
    def unpacked(cls, raw: bytes) -> Stretches:
        n, raw, at, out = int.from_bytes(raw[:4], "little"), zstandard.decompress(raw[4:]), 0, []
        for k in cls.KINDS:
            size = n * np.dtype(k).itemsize
            out.append(np.frombuffer(raw[at : at + size], k).astype(np.uint64 if k == "<u8" else np.int64))
            at += size
        return cls(*out)

    def content(self, texts: list[bytes], i: int, length: int) -> bytes:
        return texts[self.row[i]][self.first[i] : self.first[i] + self.count[i] - 1 + length]


def cut(pieces: list[tuple[int, int, bytes]], length: int, depth: int) -> Stretches:
    """The stretches of ``pieces`` (row, first start, bytes) under anchors of ``depth`` bytes."""
    digest = xxhash.xxh3_64_intdigest
    row, first, count, place, anchor, whole = [], [], [], [], [], []
    for i, base, raw in pieces:
        at = anchors(raw, length, depth)
        if not len(at):
            continue
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        stop = np.r_[begin[1:], len(at)]
        row += [i] * len(begin)
        first += (begin + base).tolist()
        count += (stop - begin).tolist()
        place += (at[begin] + base).tolist()
        anchor += [digest(raw[p : p + depth], seed=depth) for p in at[begin].tolist()]
        whole += [digest(raw[a : b - 1 + length]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    numbers = [np.array(v, np.int64) for v in (row, first, count, place)]
    return Stretches(*numbers, np.full(len(row), depth, np.int64), np.array(anchor, np.uint64), np.array(whole, np.uint64))


class Kinds:
    """The stretches of a chunk by (anchor, content): one of each kind in ``one``, in anchor order, and how often it occurs."""

    def __init__(self, s: Stretches):
        self.order, self.firsts, self.group = ch.grouped(s.anchor, s.whole)
        self.one = self.order[self.firsts]
        self.times = np.bincount(self.group, minlength=len(self.firsts))

    def checked(self, s: Stretches, texts: list[bytes], length: int) -> None:
        """Holds what counts as equal against the bytes."""
        for g in np.flatnonzero(self.times > 1).tolist():
            members = self.order[self.firsts[g] : self.firsts[g] + self.times[g]].tolist()
            if len({s.content(texts, i, length) for i in members}) > 1:
                raise RuntimeError("two stretches with equal hashes differ")


def multikey(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order the rows of ``words`` by three-way radix quicksort on one column after another.

    Returns the order and the runs (start, stop) of more than one row that agree in all columns. Short
    ranges are finished by comparing whole rows.
    """
    n, depth = words.shape
    order, runs, todo = np.arange(n), [], [(0, n, 0)]
    swapped = np.ascontiguousarray(words.astype(">u8"))  # bytes compare like the numbers
    while todo:
        a, b, d = todo.pop()
        if b - a < 2:
            continue
        if d == depth:
            runs.append((a, b))
            continue
        rows = order[a:b]
        if b - a <= 24:
            keys = [swapped[r].tobytes() for r in rows.tolist()]
            ranked = sorted(range(b - a), key=keys.__getitem__)
            order[a:b] = rows[ranked]
            start = 0
            for i in range(1, b - a + 1):
                if i == b - a or keys[ranked[i]] != keys[ranked[start]]:
                    if i - start > 1:
                        runs.append((a + start, a + i))
                    start = i
            continue
        key = words[rows, d]
        pivot = key[len(key) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[a:b] = np.concatenate([rows[less], rows[same], rows[more]])
        i, j = a + int(less.sum()), b - int(more.sum())
        todo += [(a, i, d), (i, j, d + 1), (j, b, d)]
    return order, sorted(runs)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, at least ``start`` being known to agree."""
    size = min(len(a), len(b))
    if a[start:size] == b[start:size]:
        return size
    step = 16
    while a[start : start + step] == b[start : start + step]:
        start += step
        step *= 2
    while step > 1:
        step //= 2
        if a[start : start + step] == b[start : start + step]:
            start += step
    return start


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, lcp of each with the one before) of ``strings``, by insertion into a blind trie.

    An inner node knows only the depth at which its strings part and the byte there (-1 for an end).
    A string first goes down blindly to some leaf; one comparison with that leaf gives its true
    common prefix, and the node to be made lies on the same path at that depth.
    """
    root: list | int = 0  # a leaf is a string's number; a node is [depth, {byte: child}, equal strings]
    equal: dict[int, list[int]] = {}

    def byte(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):
            child = node[1].get(byte(s, node[0]))
            node = next(iter(node[1].values())) if child is None else child
        depth = common(s, strings[node])
        if depth == len(s) == len(strings[node]):
            equal.setdefault(node, []).append(i)
            continue
        above, node2 = None, root
        while isinstance(node2, list) and node2[0] < depth:
            above, node2 = node2, node2[1][byte(s, node2[0])]
        if isinstance(node2, list) and node2[0] == depth:
            node2[1][byte(s, depth)] = i
        else:
            new = [depth, {byte(strings[node], depth): node2, byte(s, depth): i}]
            if above is None:
                root = new
            else:
                above[1][byte(s, above[0])] = new
    order, lcp, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, list):
            children = [c for _, c in sorted(node[1].items(), key=lambda x: x[0])]
            stack += [(c, node[0]) for c in reversed(children[1:])] + [(children[0], shared)]
        else:
            order.append(node)
            lcp.append(shared)
            for j in equal.get(node, ()):
                order.append(j)
                lcp.append(len(strings[j]))
    return order, lcp


def repeated_in(content: list[bytes], place: list[int], length: int) -> list[np.ndarray]:
    """Of different stretches under one anchor: for each start of each, whether another stretch has its string.

    ``place`` is the anchor's place in each stretch.
    """
    m = len(content)
    if m == 2:  # a trie of two leaves: one common prefix on either side
        (a, b), (p, q) = content, place
        right, left = common(a[p:], b[q:]), common(a[:p][::-1], b[:q][::-1])
        out = []
        for c, at in ((a, p), (b, q)):
            offset = at - np.arange(len(c) - length + 1)  # bytes left of the anchor
            within = np.minimum(p, q) >= offset
            out.append(within & (offset <= left) & (length - offset <= right))
        return out
    starts = np.array([len(c) - length + 1 for c in content])
    at = np.array(place)
    low, high = at - starts + 1, at  # bytes left of the anchor, at the last and the first start
    lo, hi = int(max(0, low.min())), int(high.max())
    cuts = np.arange(lo, hi + 1)

    def classes(strings: list[bytes], depth: np.ndarray) -> np.ndarray:
        order, lcp = blind_trie(strings)
        part = np.cumsum(np.array(lcp)[None, :] < depth[:, None], axis=1)
        out = np.empty_like(part)
        out[:, order] = part
        return out

    left = classes([c[p - 1 :: -1] if p else b"" for c, p in zip(content, place, strict=True)], cuts)
    right = classes([c[p:] for c, p in zip(content, place, strict=True)], length - cuts)
    key = left * (m + 1) + right
    valid = (cuts[:, None] >= low[None, :]) & (cuts[:, None] <= high[None, :])
    key = np.where(valid, key, -1 - np.arange(m)[None, :])
    order = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, order, 1)
    same = ranked[:, 1:] == ranked[:, :-1]
    twin = np.zeros_like(key, bool)
    twin[:, 1:] |= same
    twin[:, :-1] |= same
    found = np.empty_like(twin)
    np.put_along_axis(found, order, twin, 1)
    return [found[h - lo - s + 1 : h - lo + 1, i][::-1] for i, (h, s) in enumerate(zip(high.tolist(), starts.tolist(), strict=True))]


def _census(names: np.ndarray, anchor: np.ndarray, whole: np.ndarray, times: np.ndarray, depth: np.ndarray, group: int, length: int) -> np.ndarray:
    """For each kind of each chunk: whether its anchor occurs again, is hot, and in how many groups it meets."""
    order, firsts, of = ch.grouped(anchor)
    total = np.bincount(of, weights=times.astype(np.float64), minlength=len(firsts))
    entries = np.bincount(of, minlength=len(firsts))
    _, kind_firsts, kind = ch.grouped(anchor, whole)
    kinds = np.bincount(of[ch.grouped(anchor, whole)[0][kind_firsts]], minlength=len(firsts))
    hot = (kinds > group) & (depth[order[firsts]] < length)
    split = np.ceil(np.log2(np.maximum(entries / (8 * group), 1))).astype(np.int64)
    return (AGAIN * (total > 1) + HOT * ((total > 1) & hot) + GROUPS * np.where(hot, 0, np.minimum(split, 63)))[of]


def _sort(length: int):
    """The meeting of the second pass: sort the stretches of one part, answer every start."""

    def meet(names: list[int], counts: list[int], data: list[tuple[bytes, ...]]) -> np.ndarray:
        content: list[bytes] = []
        place: list[int] = []
        depth: list[int] = []
        times: list[int] = []
        unzstd = zstandard.ZstdDecompressor()
        for (raw,) in data:
            raw = unzstd.decompress(raw)
            n = int.from_bytes(raw[:4], "little")
            sizes, *more = np.frombuffer(raw[4 : 4 + 16 * n], "<u4").reshape(4, n).tolist()
            for column, values in zip((place, depth, times), more, strict=True):
                column += values
            at = 4 + 16 * n
            for size in sizes:
                content.append(raw[at : at + size])
                at += size
        starts = np.array([len(c) - length + 1 for c in content], np.int64)
        ends = np.cumsum(starts)
        marks = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        for k in sorted(set(depth)):
            mine = [i for i, d in enumerate(depth) if d == k]
            wide = -(-k // 8)
            words = np.frombuffer(b"".join(content[i][place[i] : place[i] + k].ljust(8 * wide, b"\0") for i in mine), ">u8").reshape(len(mine), wide)
            order, runs = multikey(words.astype(np.uint64))
            alone = np.ones(len(mine), bool)
            for a, b in runs:
                alone[a:b] = False
            runs += [(a, a + 1) for a in np.flatnonzero(alone).tolist()]
            for a, b in runs:
                rows = [mine[i] for i in order[a:b].tolist()]
                kinds: dict[tuple[bytes, int], list[int]] = {}
                for i in rows:
                    kinds.setdefault((content[i], place[i]), []).append(i)
                several = repeated_in([c for c, _ in kinds], [p for _, p in kinds], length) if len(kinds) > 1 else [None]
                for members, found in zip(kinds.values(), several, strict=True):
                    again = sum(times[i] for i in members) > 1
                    for i in members:
                        at = int(ends[i] - starts[i])
                        if again:
                            marks[at : at + int(starts[i])] |= REPEATED
                        elif found is not None:
                            marks[at : at + int(starts[i])] |= found.astype(np.uint8) * np.uint8(REPEATED)
                    first = members[0]
                    marks[int(ends[first] - starts[first])] |= SURVIVOR
        return marks

    return meet


class Sent:
    """What a chunk sends to the sort after a census: kinds of repeated anchors, in the order of their groups."""

    def __init__(self, name: int, s: Stretches, kinds: Kinds, marks: np.ndarray):
        chosen = np.flatnonzero((marks & AGAIN > 0) & (marks & HOT == 0))
        split = (marks[chosen] // GROUPS).astype(np.uint64)
        salt = ch.mixed(np.full(len(chosen), name, np.int64).astype(np.uint64), s.anchor[kinds.one[chosen]]) >> np.uint64(8) & ((np.uint64(1) << split) - np.uint64(1))
        key = np.where(split > 0, ch.mixed(s.anchor[kinds.one[chosen]], salt), s.anchor[kinds.one[chosen]])
        order = np.argsort(key, kind="stable")
        #: Numbers of the kinds, the groups they meet in, and whether these are of a split anchor.
        self.kinds, self.key, self.split = chosen[order], key[order], split[order] > 0
        self.one = kinds.one[self.kinds]
        self.n = int(s.count[self.one].sum())


def replay(name: int, texts: list[bytes] | None, s: Stretches, stages: list[tuple[str, str]], length: int, covered: np.ndarray | None = None, starts: np.ndarray | None = None) -> Stretches:
    """The stretches of a chunk that are still open after ``stages`` (census and sort answers).

    With ``covered``, counts of removed bytes as differences over the chunk's texts (which begin at
    ``starts``) are added to it.
    """
    for known, sorted_ in stages:
        kinds = Kinds(s)
        marks = ch.answers(known, name, len(kinds.one))
        sent = Sent(name, s, kinds, marks)
        found = ch.answers(sorted_, name, sent.n)
        counts = s.count[sent.one]
        at = np.cumsum(counts) - counts
        repeated = np.add.reduceat(found & REPEATED, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        if covered is not None:
            full = np.zeros(len(kinds.one), bool)
            full[sent.kinds[repeated == counts]] = True
            all_of = np.flatnonzero(full[kinds.group])
            begin = starts[s.row[all_of]] + s.first[all_of]
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + s.count[all_of] - 1 + length, -1)
            for i in np.flatnonzero((repeated > 0) & (repeated < counts)).tolist():
                edge = np.flatnonzero(np.diff((found[at[i] : at[i] + counts[i]] & REPEATED).astype(np.int8), prepend=0, append=0))
                base = int(starts[s.row[sent.one[i]]] + s.first[sent.one[i]])  # a kind that is not full occurs once here
                np.add.at(covered, base + edge[::2], 1)
                np.add.at(covered, base + edge[1::2] - 1 + length, -1)
        going = sent.one[sent.split & (found[at] & SURVIVOR > 0)] if len(at) else np.zeros(0, np.int64)
        hot = np.flatnonzero((marks & HOT > 0)[kinds.group])
        left = s.take(going)
        for depth in np.unique(s.depth[hot]).tolist():
            these = hot[s.depth[hot] == depth].tolist()
            pieces = [(int(s.row[i]), int(s.first[i]), s.content(texts, i, length)) for i in these]
            left = left.plus(cut(pieces, length, min(2 * depth, length)))
        s = left
        if not len(s.row):
            break
    return s


def repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, group: int = GROUP) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_bytes`` also kept (binary)
    and spans array<struct<first,after>>. ``group`` bounds the different stretches that are sorted under
    one anchor; the result does not depend on it.
    """
    if length < 2 * K:
        raise ValueError(f"strings must have {2 * K} bytes at least")
    packed = ch.pack(
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")),
        lambda texts: cut([(i, 0, t) for i, t in enumerate(texts)], length, K).packed(),
    )
    parts = ch.parts_of(packed)
    stages: list[tuple[str, str]] = []

    def counted(name: int, s: Stretches) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(s)
        if len(kinds.one):
            yield ch.blocks(name, s.anchor[kinds.one], parts, 64, s.whole[kinds.one], np.minimum(kinds.times, 2).astype(np.uint64), s.depth[kinds.one].astype(np.uint64))

    def meeting(names: np.ndarray, anchor: np.ndarray, whole: np.ndarray, times: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return _census(names, anchor, whole, times, depth, group, length)

    def sender(stages: list[tuple[str, str]], known: str):
        def send(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
            s = replay(chunk.name, chunk.texts, Stretches.unpacked(chunk.more), stages, length)
            kinds = Kinds(s)
            kinds.checked(s, chunk.texts, length)
            sent = Sent(chunk.name, s, kinds, ch.answers(known, chunk.name, len(kinds.one)))
            if not len(sent.one):
                return
            edges = np.searchsorted(sent.key, (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)) if parts > 1 else np.zeros(0, np.int64)
            cuts = np.concatenate([[0], edges, [len(sent.one)]]).astype(np.int64).tolist()
            rows: list[list] = [[], [], [], []]
            zstd = zstandard.ZstdCompressor(level=1)
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a == b:
                    continue
                at = sent.one[a:b]
                pieces = [s.content(chunk.texts, i, length) for i in at.tolist()]
                head = np.array([list(map(len, pieces)), (s.place[at] - s.first[at]).tolist(), s.depth[at].tolist(), np.minimum(kinds.times[sent.kinds[a:b]], 2).tolist()], "<u4")
                raw = len(pieces).to_bytes(4, "little") + head.tobytes() + b"".join(pieces)
                for column, value in zip(rows, (p, chunk.name, int(s.count[at].sum()), zstd.compress(raw)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], names=["part", "chunk", "n", "v0"])

        return send

    schema = ch.BLOCK + ", v1 binary, v2 binary, v3 binary"
    for turn in range(ROUNDS):
        if turn == 0:
            census = ch.each_prepared(packed, lambda name, more: counted(name, Stretches.unpacked(more)), schema)
        else:
            before = list(stages)
            census = ch.each(packed, lambda c, before=before: counted(c.name, replay(c.name, c.texts, Stretches.unpacked(c.more), before, length)), schema)
        known, top = ch.answered(census, parts, ch.by_key(meeting), f"census-{turn}", every_bit=True)
        if not top & AGAIN:
            break
        sorted_, _ = ch.answered(ch.each(packed, sender(list(stages), known), ch.BLOCK), parts, _sort(length), f"sorted-{turn}")
        stages.append((known, sorted_))
        if top < HOT:
            break
    else:
        raise RuntimeError(f"hot anchors are left after {ROUNDS} rounds")

    def result(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
        covered = np.zeros(len(chunk.blob) + 1, np.int32)
        replay(chunk.name, chunk.texts, Stretches.unpacked(chunk.more), stages, length, covered, chunk.starts)
        gone = np.cumsum(covered) > 0  # no string reaches the blank after its text
        edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        begin, end = edge[::2], edge[1::2]
        owner = np.searchsorted(begin, chunk.starts).tolist()
        rows: list[list] = [[], [], [], [], [], []]
        for i, text in enumerate(chunk.texts):
            base = int(chunk.starts[i])
            spans = [(a - base, b - base) for a, b in zip(begin[owner[i] : owner[i + 1]].tolist(), end[owner[i] : owner[i + 1]].tolist(), strict=True)]
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            for column, value in zip(rows, (len(text), len(text) - len(left), len(spans), sha256(left).hexdigest(), left, [{"first": a, "after": b} for a, b in spans] if with_bytes else None), strict=True):
                column.append(value)
        out = {"doc_id": chunk.table.column("doc_id").combine_chunks(), "n_bytes": pa.array(rows[0], pa.int64()), "n_removed": pa.array(rows[1], pa.int64()), "n_spans": pa.array(rows[2], pa.int64()), "kept_sha256": pa.array(rows[3], pa.string())}
        if with_bytes:
            out |= {"kept": pa.array(rows[4], pa.binary()), "spans": pa.array(rows[5], pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))}
        yield from pa.table(out).combine_chunks().to_batches()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return ch.each(packed, result, schema + ", kept binary, spans array<struct<first:long,after:long>>" * with_bytes)
