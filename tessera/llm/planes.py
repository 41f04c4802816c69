"""Token-id files: byte or bit planes, zstandard, and a chunk index.

A file holds ids of whole documents. The ids are cut into chunks of a fixed number of ids; a chunk
is transposed into planes (all lowest bytes, then all second bytes, and so on; or single bits), and
each plane is one zstandard frame. The index after the chunks gives every plane's place, so that a
reader fetches any chunk alone. A document table (id and length) follows in the same coding.

Layout, little-endian: magic, format byte (plane kind), 3 zero bytes, ids a chunk u32 | planes |
chunk index: per chunk offset u64, ids u32, and a length u32 for each plane | document ids and
lengths as two blocks of 8-byte planes, each with its own lengths | footer: index offset u64,
document offset u64, chunks u32, documents u64, ids u64, magic.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, keyed, shared_path, slices, worker, written

MAGIC = b"TIDP"
BYTES, BITS = 0, 1
FOOTER = struct.Struct("<QQIQQ4s")
CHUNK_IDS = 65_536
#: Words kept with their ids in each worker.
KEPT_WORDS = 1_000_000


def split_planes(values: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block of fixed-width little-endian values."""
    width = values.dtype.itemsize
    grid = values.view(np.uint8).reshape(len(values), width)
    if kind == BYTES:
        return [grid[:, i].tobytes() for i in range(width)]
    bits = np.unpackbits(grid, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(8 * width)]


def join_planes(planes: list[bytes], count: int, dtype: str, kind: int) -> np.ndarray:
    """The values whose planes these are."""
    width = np.dtype(dtype).itemsize
    if kind == BYTES:
        grid = np.empty((count, width), np.uint8)
        for i, plane in enumerate(planes):
            grid[:, i] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.empty((count, 8 * width), np.uint8)
        for i, plane in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=count)
        grid = np.packbits(bits, axis=1, bitorder="little")
    return grid.reshape(-1).view(dtype)


class PlaneWriter:
    """Writes one file to ``out``; holds one chunk of ids and the document table."""

    def __init__(self, out, kind: int = BYTES, chunk_ids: int = CHUNK_IDS, level: int = 3):
        self.out, self.kind, self.chunk_ids = out, kind, chunk_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at = 0
        self._put(MAGIC + struct.pack("<B3xI", kind, chunk_ids))
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.index: list[bytes] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _block(self, values: np.ndarray) -> list[int]:
        packed = [self.zstd.compress(p) for p in split_planes(values, self.kind)]
        for p in packed:
            self._put(p)
        return [len(p) for p in packed]

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids.astype("<u4"))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.chunk_ids:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.chunk_ids
            for i in range(0, cut, self.chunk_ids):
                self._chunk(whole[i : i + self.chunk_ids])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _chunk(self, ids: np.ndarray) -> None:
        start = self.at
        self.index.append(struct.pack(f"<QI{len(lengths := self._block(np.ascontiguousarray(ids)))}I", start, len(ids), *lengths))

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        index_at = self.at
        self._put(b"".join(self.index))
        docs_at, tables = self.at, io.BytesIO()
        for column in (self.docs, self.lengths):
            packed = [self.zstd.compress(p) for p in split_planes(np.array(column, "<i8"), self.kind)]
            tables.write(struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed))
        self._put(tables.getvalue())
        self._put(FOOTER.pack(index_at, docs_at, len(self.index), len(self.docs), self.n_ids, MAGIC))


class PlaneReader:
    """Reads one file through a seekable ``source``."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(0)
        head = source.read(12)
        source.seek(size - FOOTER.size)
        index_at, docs_at, self.n_chunks, self.n_docs, self.n_ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if head[:4] != MAGIC or magic != MAGIC:
            raise ValueError("not a token-id file")
        self.kind, self.chunk_ids = struct.unpack("<B3xI", head[4:])
        self.unzstd = zstandard.ZstdDecompressor()
        self.planes = 4 if self.kind == BYTES else 32
        source.seek(index_at)
        entry = struct.Struct(f"<QI{self.planes}I")
        raw = source.read(docs_at - index_at)
        self.index = [entry.unpack_from(raw, i * entry.size) for i in range(self.n_chunks)]
        raw, self.table, at = source.read(size - FOOTER.size - docs_at), [], 0
        for _ in range(2):
            lengths = struct.unpack_from(f"<{2 * self.planes}I", raw, at)
            at += 8 * self.planes
            planes = []
            for n in lengths:
                planes.append(self.unzstd.decompress(raw[at : at + n]))
                at += n
            self.table.append(join_planes(planes, self.n_docs, "<i8", self.kind))

    def chunk(self, i: int) -> np.ndarray:
        at, count, *lengths = self.index[i]
        self.source.seek(at)
        raw, planes, start = self.source.read(sum(lengths)), [], 0
        for n in lengths:
            planes.append(self.unzstd.decompress(raw[start : start + n]))
            start += n
        return join_planes(planes, count, "<u4", self.kind)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in the file's order; holds the ids of one document and one chunk."""
        chunk, held = 0, np.zeros(0, "<u4")
        for doc_id, n in zip(self.table[0].tolist(), self.table[1].tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(chunk))
                have += len(parts[-1])
                chunk += 1
            whole = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, whole[:n]
            held = whole[n:]


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Bytes of text in a token file, about.
FILE_BYTES = 64 << 20
#: The normalizer and the splitting of the tokenizer files that ``WordCoder`` can take apart.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None,
    "padding": None,
}
#: Line ends and tabs as blanks.
BLANKS = bytes.maketrans(b"\n\t\r", b"   ")


class Known(dict):
    """Words with their ids; a word not there yet is worked and kept."""

    def __init__(self, work, items=()):
        super().__init__(items)
        self.work = work

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.work(word)
        return found


class WordCoder:
    """texts -> little-endian ids, by the tokenizers library.

    The tokenizer's rules never look across ASCII white space, never join a letter or number with a
    punctuation run after it, and take letters case by case; so each distinct lower-cased word is
    worked once and remembered, a closing punctuation run apart. A word of letters alone is one
    piece and goes straight to the library's model; anything else takes the library's whole path,
    as does a text that may spell a special token. All this holds for tokenizer files with the rules of
    ``WORDWISE`` and special tokens that begin with "<|"; with any other file every text goes whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        rules = json.loads(self.tok.to_str())
        self.wordwise = all(rules.get(k) == v for k, v in WORDWISE.items()) and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        self.known = Known(self.word)
        self.table = str.maketrans(self.letters)

    def whole(self, word: str) -> list[int]:
        return self.tok.encode(word, add_special_tokens=False).ids

    def piece(self, core: str) -> list[int]:
        if core.isascii() and core.isalpha():
            return [t.id for t in self.model.tokenize(core)]
        if core.isalpha() and not (is_normalized("NFC", core) and core == core.lower()):
            core = self.tok.normalizer.normalize_str(core)
        if core.isalpha():
            return [t.id for t in self.model.tokenize(core.encode().decode("latin-1").translate(self.table))]
        return self.whole(core)

    def word(self, word: str) -> bytes:
        core = word.rstrip(punctuation)
        if len(core) < len(word) and core and normalize("NFC", core[-1]).lower().isalnum():
            return self.known[core] + self.known[word[len(core) :]]
        return np.array(self.piece(word), "<u4").tobytes() if word else b""

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known = Known(self.word, list(self.known.items())[len(self.known) // 2 :])
        known, out = self.known.__getitem__, []
        for text in texts:
            if not self.wordwise or "<|" in text:
                out.append(np.array(self.whole(text), "<u4").tobytes())
            else:
                words = text.encode().lower().translate(BLANKS).decode().split(" ")
                out.append(b"".join(map(known, words)))
        return out


@lru_cache(maxsize=1)
def word_coder(path: str) -> WordCoder:
    """The coder of a tokenizer file, read once in each worker."""
    return WordCoder(path)


KEPT["planes"] = word_coder.cache_clear


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, kind: int = BYTES, chunk_ids: int = CHUNK_IDS, files: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids in ascending doc_id order.

    Returns the written files: shard int, path, n_docs, n_ids, start (ids in all files before).
    The ids are cut into ``files`` ranges of doc_id at quantiles; a file takes its range sorted, as
    a stream. A file is written under a name of its own and then moved, so a repeated task leaves
    the same single file. Null texts count as empty; null ids come first (stored as the smallest
    long); repeated ids stay next to each other, ordered by their ids.
    """
    source = keyed(docs, id_col, text_col)
    probes = [i / files for i in range(1, files)]
    cuts = source.select("doc_id").approxQuantile("doc_id", probes, 0.1 / files) if probes else []
    edges = np.unique(np.array(cuts, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts)).fill_null(-(1 << 63))
                at += len(texts)
                shard = np.searchsorted(edges, ids.to_numpy(zero_copy_only=False), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array([x + end for x in coder(texts)], pa.binary())], names=["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, raw = None, None, None
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if shard is None:
                shard = batch.column(0)[0].as_py()
                fs.create_dir(base, recursive=True)
                own = f"{base}/.{uuid.uuid4().hex}"
                raw = fs.open_output_stream(own)
                out = PlaneWriter(raw, kind, chunk_ids)
            for doc_id, ids in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                out.add(doc_id, np.frombuffer(ids.as_buffer(), "<u4"))
        if shard is not None:
            out.close()
            raw.close()
            path = f"{base}/ids-{shard:06d}.tidp"
            fs.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/ids-{shard:06d}.tidp"]), pa.array([len(out.docs)], pa.int64()), pa.array([out.n_ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    dealt = source.mapInArrow(worker("planes", encode), "shard int, doc_id long, ids binary").repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    found = written(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "token-files")
    # one row a file: the running sum is over the files, not the documents
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of ``files``, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    rows: list[list] = [[], [], [], []]
                    for doc_id, ids in PlaneReader(source, source.size()).documents():
                        for column, value in zip(rows, (None if doc_id == -(1 << 63) else doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = files.select("path", "start")
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and read them back.

    ``files`` is by default one for every ``FILE_BYTES`` of text, the session's number of shuffle partitions at least.
    """
    spark = docs.sparkSession
    if files is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    return read_token_files(write_token_files(docs, tokenizer_path, shared_path(spark, "ids"), end_id, files=files, id_col=id_col, text_col=text_col))
