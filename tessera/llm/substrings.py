"""Substring dedup by level-wise doubling.

Windows of words are compared length by length, each length about twice the one before and the last
one the window itself: a window of length 2 n can only repeat where both its halves repeat, so only
windows whose halves were found repeated are extended and sent to the next level. A level is one
packed exchange (see ``chunks``): at the lower levels short fingerprints ask "does this occur
elsewhere?", where a false yes only costs a later comparison; at the last level 96-bit fingerprints
carry the smallest doc_id of each chunk and ask "does this start in a smaller document?".

Words are split at ASCII white space and otherwise unchanged. Null texts have no words. A null doc_id
is smaller than all others; documents of one doc_id count as one document. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import chunks as ch

#: Longer words are hashed one by one with a stronger hash.
LONG_WORD = 1024
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def levels(window: int, first: int = 4) -> list[int]:
    """Window lengths from about ``first`` up to ``window``, each at most twice the one before."""
    found = [window]
    while found[0] > first:
        found.insert(0, (found[0] + 1) // 2)
    return found


class Words:
    """Word hashes of a chunk, the document of each word, and window hashes of any level."""

    def __init__(self, chunk: ch.Chunk):
        raw = np.frombuffer(chunk.blob, np.uint8)
        blank = BLANK[raw]
        inner = ~blank
        edge = np.diff(inner.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.multiply(ch.byte_values()[raw], ch.powers(ch.BASE, len(raw)), out=sums[1:])
        np.cumsum(sums, out=sums)
        h = (sums[self.end] - sums[self.begin]) * ch.powers(ch.UNBASE, len(raw))[self.begin]
        del sums
        self.hashes = ch.mixed(h, (self.end - self.begin).astype(np.uint64))
        for i in np.flatnonzero(self.end - self.begin > LONG_WORD).tolist():
            self.hashes[i] = xxhash.xxh3_64_intdigest(chunk.blob[self.begin[i] : self.end[i]])
        #: Row of the chunk to which each word belongs.
        self.row = np.searchsorted(chunk.starts, self.begin, side="right") - 1

    def windows(self, lengths: list[int], salt: int = 0) -> np.ndarray:
        """Hashes of the windows of the last of ``lengths``, built through all of them; one for each start."""
        have, f = 1, self.hashes
        for n in lengths:
            while have < n:
                step = min(have, n - have)
                if len(f) <= step:
                    return f[:0]
                f = ch.mixed(f[:-step], f[step:], salt)
                have += step
        return f

    def inside(self, length: int) -> np.ndarray:
        """Whether the window that starts at each word (as many as fit the chunk) is of one document."""
        if len(self.row) < length:
            return np.zeros(0, bool)
        return self.row[: len(self.row) - length + 1] == self.row[length - 1 :]


def _survivors(words: Words, name: int, lengths: list[int], folders: list[str], bits: int) -> np.ndarray:
    """Start words of the windows of the last of ``lengths`` whose halves repeat at every level before."""
    before = None
    for level, n in enumerate(lengths):
        ok = words.inside(n)
        if before is not None:
            m = lengths[level - 1]
            ok = ok & before[: len(ok)] & before[n - m : n - m + len(ok)]
        at = np.flatnonzero(ok)
        if level == len(lengths) - 1:
            return at
        keys, inverse, counts = _distinct(words.windows(lengths[: level + 1])[at] >> np.uint64(64 - bits))
        repeats = (ch.answers(folders[level], name, len(keys)) > 0) | (counts > 1)
        before = np.zeros(len(words.row), bool)
        before[at] = repeats[inverse]
    return np.zeros(0, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, firsts, group = ch.grouped(keys)
    return keys[order][firsts], group, np.bincount(group, minlength=len(firsts))


def _elsewhere(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether another chunk sent the same key (a chunk sends it once)."""
    _, firsts, group = ch.grouped(keys)
    return np.bincount(group, minlength=len(firsts))[group] > 1


def _smaller(names: np.ndarray, keys: np.ndarray, rest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether any chunk sent the same 96 bits with a smaller document."""
    order, firsts, group = ch.grouped(keys, rest)
    ids = doc.view(np.int64)
    least = np.minimum.reduceat(ids[order], firsts) if len(order) else ids
    return least[group] < ids


def _last(words: Words, chunk: ch.Chunk, at: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, ...]:
    """(keys, rest, smallest document) of the distinct windows at ``at``, and the group of each."""
    full, rest = words.windows(lengths)[at], words.windows(lengths, salt=1)[at] >> np.uint64(32)
    order, firsts, group = ch.grouped(full, rest)
    first = order[firsts]  # words run in ascending doc_id order
    return full[first], rest[first], chunk.doc_ids[words.row[at[first]]], group


def repeated_words(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256; with ``with_text`` also kept_text and every
    other column of ``docs`` (columns of those names are replaced).
    """
    own = {"doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept_text"}
    others = [c for c in docs.columns if c not in own | {id_col, text_col}] if with_text else []
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in others])
    packed = ch.pack(source)
    parts = ch.parts_of(packed)
    total = packed.agg(F.sum("bytes")).first()[0] or 1
    lengths = levels(window)
    # short keys at the pruning levels: enough bits that chance repeats are rare at this size
    bits = min(64, max(32, int(total).bit_length() + 5))
    folders: list[str] = []
    for level in range(len(lengths) - 1):

        def ask(chunk: ch.Chunk, folders=tuple(folders), level=level) -> Iterator[pa.RecordBatch]:
            words = Words(chunk)
            at = _survivors(words, chunk.name, lengths[: level + 1], folders, bits)
            keys, _, _ = _distinct(words.windows(lengths[: level + 1])[at] >> np.uint64(64 - bits))
            if len(keys):
                yield ch.blocks(chunk.name, keys, parts, bits)

        folders.append(ch.answered(ch.each(packed, ask, ch.BLOCK), parts, ch.by_key(_elsewhere), f"level-{lengths[level]}")[0])

    def ask_last(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
        words = Words(chunk)
        at = _survivors(words, chunk.name, lengths, folders, bits)
        if len(at):
            keys, rest, doc, _ = _last(words, chunk, at, lengths)
            yield ch.blocks(chunk.name, keys, parts, 64, rest, doc.view(np.uint64))

    last = ch.answered(ch.each(packed, ask_last, ch.BLOCK + ", v1 binary, v2 binary"), parts, ch.by_key(_smaller), f"level-{window}")[0]

    def result(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
        words = Words(chunk)
        removed = np.zeros(len(words.row) + 1, np.int64)
        at = _survivors(words, chunk.name, lengths, folders, bits)
        if len(at):
            keys, _, doc, group = _last(words, chunk, at, lengths)
            smaller = ch.answers(last, chunk.name, len(keys)) > 0
            hit = at[smaller[group] | (chunk.doc_ids[words.row[at]] > doc[group])]
            np.add.at(removed, hit, 1)
            np.add.at(removed, hit + window, -1)
        gone = np.cumsum(removed)[:-1] > 0
        edges = np.searchsorted(words.row, np.arange(len(chunk.texts) + 1))
        counts = np.diff(edges)
        dropped = np.add.reduceat(np.append(gone, False), edges[:-1], dtype=np.int64) if len(chunk.texts) else counts
        dropped = np.where(counts > 0, dropped, 0)
        kept = []
        for i, text in enumerate(chunk.texts):
            own_words = text.split()
            if dropped[i]:
                mask = gone[edges[i] : edges[i + 1]].tolist()
                own_words = [w for w, g in zip(own_words, mask, strict=True) if not g]
            kept.append(b" ".join(own_words))
        table = chunk.table
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(dropped, pa.int64()), "kept_sha256": pa.array([sha256(k).hexdigest() for k in kept])}
        if with_text:
            out["kept_text"] = pa.array([k.decode() for k in kept])
            out |= {c: table.column(c) for c in others}
        yield from pa.table(out).combine_chunks().to_batches()

    schema = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = StructType([*schema.add("kept_text", "string").fields, *source.select(*[f"`{c}`" for c in others]).schema.fields])
    return ch.each(packed, result, schema)
