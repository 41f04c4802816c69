"""Byte-level BPE by segment trees.

A piece of text is a row of byte positions. Each live position carries the token that starts there
and, as key, the rank of the pair it forms with its right live neighbour. A segment tree over the
positions keeps the smallest key; keys hold (rank, position), so the root names the leftmost
minimum pair. A merge changes three keys: of the merged position, of its left neighbour and of the
position that went away; each is a point update along one path of the tree. Pieces of like length
are worked in lock step as rows of one numpy array; the trees stay separate.

Null texts count as empty. An empty text has no ids. Ids decode to the exact input bytes.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, by_batch, keyed, slices

#: Above every key; a position without a live right neighbour has it.
NONE = np.int64(1) << 60
#: Pieces kept with their ids in each worker; the oldest half goes when it is full.
KEPT_PIECES = 400_000
#: Longer pieces are merged one at a time, with the tree in plain lists.
LONG_PIECE = 512


class PairTable:
    """(left id, right id) -> rank of the joined bytes, as an open-addressing table in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.width = np.int64(max(ranks.values(), default=0) + 1)
        bits = max(4, (4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int64)
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        slots, todo, rank = self._slot(keys), np.arange(len(keys)), np.array(rank, np.int64)
        while len(todo):
            free = self.keys[slots[todo]] == -1
            take = todo[free]
            self.keys[slots[take]] = keys[take]  # of several that meet, the last one stays
            won = self.keys[slots[todo]] == keys[todo]
            self.ranks[slots[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where the pair does not join or one side is -1."""
        keys = left * self.width + right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class BytePairCoder:
    """Encode texts to ids and ids to bytes under ``ranks``; each match of ``pattern`` is its own piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.one_of = list(range(max(self.bytes_of) + 1))
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece, by merges alone."""
        out: list = [()] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        start, stop = np.searchsorted(lengths[order], [1, LONG_PIECE + 1]).tolist()
        for i in order[stop:].tolist():
            out[i] = self._merge_long(pieces[i])
        order = order[:stop]
        while start < len(order):
            leaves = 1 << max(1, int(lengths[order[start]] - 1).bit_length())
            end = int(np.searchsorted(lengths[order], leaves, side="right"))
            end = min(end, start + max(1, 262_144 // leaves))
            rows = order[start:end]
            for i, ids in zip(rows.tolist(), self._merge_rows([pieces[i] for i in rows], leaves), strict=True):
                out[i] = ids
            start = end
        return out

    def _merge_rows(self, pieces: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        n, levels = len(pieces), leaves.bit_length() - 1
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        length = np.fromiter(map(len, pieces), np.int64, n)[:, None]
        place = np.arange(leaves, dtype=np.int64)[None, :]
        ids = np.where(place < length, self.single[raw], -1)
        after = np.where(place + 1 < length, place + 1, leaves)  # ``leaves`` stands for none
        before = np.broadcast_to(place - 1, (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        rank = np.full((n, leaves), NONE, np.int64)
        rank[:, :-1] = self.pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, leaves - 1)
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + place, NONE)
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def update(row: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
            node = leaf + leaves
            tree[row, node] = key
            for _ in range(levels):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def pair_key(row: np.ndarray, leaf: np.ndarray, right: np.ndarray) -> np.ndarray:
            right_id = np.where(right < leaves, ids[row, np.minimum(right, leaves - 1)], -1)
            found = self.pairs.of(ids[row, leaf], right_id)
            return np.where(found < NONE, found * leaves + leaf, NONE)

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            at = best % leaves
            gone = after[row, at]
            follow = after[row, gone]
            ids[row, at] = best // leaves
            ids[row, gone] = -1
            after[row, at] = follow
            inner = follow < leaves
            before[row[inner], follow[inner]] = at[inner]
            update(row, gone, np.full(len(row), NONE))
            update(row, at, pair_key(row, at, follow))
            left = before[row, at]
            has = left >= 0
            update(row[has], left[has], pair_key(row[has], left[has], at[has]))
            row = row[tree[row, 1] < NONE]
        live = ids >= 0
        # one object for each id, however many pieces hold it
        flat, counts = list(map(self.one_of.__getitem__, ids[live].tolist())), live.sum(1).tolist()
        out, start = [], 0
        for c in counts:
            out.append(tuple(flat[start : start + c]))
            start += c
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        none, n = int(NONE), len(piece)
        leaves = 1 << (n - 1).bit_length()
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, bytes_of = self.ranks, self.bytes_of

        def key(at: int) -> int:
            right = after[at]
            if right >= n:
                return none
            rank = ranks.get(bytes_of[ids[at]] + bytes_of[ids[right]])
            return none if rank is None else rank * leaves + at

        tree = [none] * leaves + [key(i) for i in range(n)] + [none] * (leaves - n)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(leaf: int, value: int) -> None:
            node = leaf + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = after[at]
            ids[at], after[at] = rank, after[gone]
            if after[at] < n:
                before[after[at]] = at
            update(gone, none)
            update(at, key(at))
            if before[at] >= 0:
                update(before[at], key(before[at]))
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return tuple(out)

    def learn(self, pieces: set[str]) -> None:
        """Have the ids of ``pieces`` at hand."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT_PIECES:
            keep = [p for p in list(self.known)[len(self.known) // 2 :]][-KEPT_PIECES // 2 :]
            self.known = {p: self.known[p] for p in keep} | {p: self.known[p] for p in pieces if p in self.known}
        whole, parts = [], []
        for p in new:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.known[p] = (r,)
            else:
                whole.append(p)
                parts.append(raw)
        self.known.update(zip(whole, self.merge(parts), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.find(t) for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, p))) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> BytePairCoder:
    """The coder of a ``.tiktoken`` rank file, read once in each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return BytePairCoder(ranks, pattern)


KEPT["bpe"] = coder.cache_clear


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids
    array<int> and decoded (binary). One narrow pass; no shuffle. ``ranks_path`` is opened on the
    executors, where the vocabulary is installed.
    """
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = columns + ", ids array<int>, decoded binary" * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(ranks_path, pattern)
        count, id_hash, back_hash, all_ids, all_back = [], [], [], [], []
        names = [str(i) for i in range(max(c.bytes_of) + 1)]
        for texts in slices(batch.column(1), 3_000_000, 4096):
            for ids in c.encode(texts):
                back = c.decode(ids)
                count.append(len(ids))
                id_hash.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back_hash.append(sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_back.append(back)
        out = [batch.column(0), pa.array(count, pa.int64()), pa.array(id_hash, pa.string()), pa.array(back_hash, pa.string())]
        labels = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_back, pa.binary())]
            labels += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(out, names=labels)

    return by_batch(keyed(docs, id_col, text_col), run, schema, "bpe")
