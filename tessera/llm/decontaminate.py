"""Benchmark decontamination with DataFrame functions only.

The normalised test n-grams become a broadcast hash set (their number is counted first; beyond the
bound the same join runs shuffled). Every training window is hashed and probed, hits are verified
word by word, and the hits of a document are folded into covered word positions and items.

Null texts have no words. An item of fewer words than the window, but not none, is one window.
Repeated rows each keep their own output row. Items with null ids take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: A word is a run of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most test windows that are broadcast (a hash, a gram and its items: about 200 bytes each).
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """The normalised words of a text; an empty array for null."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.filter(F.split(low, BREAK), lambda w: w != ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram array<string>, items array<string>): every distinct window and the items that hold it."""
    w = F.col("w")
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(F.col(f"`{text_col}`").cast("string")).alias("w")).where("item is not null and size(w) > 0")
    last = F.greatest(F.size(w) - n + 1, F.lit(1))
    grams = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(w, i, n))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, starts (of verified windows, with lengths), items.

    A row stands for ``copies`` input rows of the same id and text; ``text_hash`` tells rows of one
    id apart, so that nothing leans on row order.
    """
    grams = written(windows(benchmark, n), "test-windows")
    bounded = grams.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    lengths = [r.k for r in grams.select(F.size("gram").alias("k")).distinct().collect()] or [n]  # 1 to n
    # windows whose hashes meet stay together, so that a probe finds one row at most
    probe = grams.groupBy(F.xxhash64("gram").alias("h")).agg(F.collect_list(F.struct("gram", "items")).alias("known"))
    if bounded:
        probe = F.broadcast(probe)
    text, w = F.col("text"), F.col("w")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("text_hash"), words(text).alias("w"))

    def hashes(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i, k)))

    # one row for the document itself (pos null), then one for each window
    seats = [F.when(F.size(w) >= k, F.transform(hashes(k), lambda h, i: F.struct(i.alias("pos"), F.lit(k).alias("k"), h.alias("h")))).otherwise(F.array().cast("array<struct<pos:int,k:int,h:bigint>>")) for k in sorted(lengths)]
    own = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("h")))
    # The array is built in a projection of its own: then explode, probe and filter fuse, and only
    # rows that hit copy the words. The outer form, over arrays that are never empty, keeps Spark
    # from testing the array's size in a filter that would compute it twice.
    rows = base.withColumn("seats", F.concat(own, *seats)).select("doc_id", "text_hash", "w", F.explode_outer("seats").alias("s")).select("doc_id", "text_hash", "w", "s.pos", "s.k", "s.h")
    met = rows.join(probe, "h", "left").where("pos is null or known is not null")
    # verified below, not in a filter: a filter with a lambda would end the fused stage and copy
    # the words into every window's row
    found = F.filter("known", lambda g: g["gram"] == F.slice(w, F.col("pos") + 1, F.col("k")))
    met = met.select("doc_id", "text_hash", F.size(w).alias("n_words"), "pos", "k", F.flatten(F.transform(found, lambda g: g["items"])).alias("items"))
    return met.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(F.col("pos").isNull()).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.size("items") > 0, F.struct("pos", "k")))).alias("starts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def covered(starts: Column) -> Column:
    """Number of word positions that sorted (pos, k) windows cover: each adds what reaches past the ones before."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["k"]
        more = F.greatest(end - F.greatest(acc["end"], s["pos"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def spans(starts: Column) -> Column:
    """Covered word positions as maximal runs (first, after)."""
    empty = F.array().cast("array<struct<first:int,after:int>>")

    def step(acc: Column, s: Column) -> Column:
        end, last = s["pos"] + s["k"], F.try_element_at(acc, F.lit(-1))
        new = F.struct(s["pos"].alias("first"), end.alias("after"))
        grown = F.struct(last["first"].alias("first"), F.greatest(last["after"], end).alias("after"))
        touches = (F.size(acc) > 0) & (s["pos"] <= last["after"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(starts, empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash, n_words, n_hit, n_items, items, spans, contaminated."""
    found = hits(docs, benchmark, n, id_col, text_col)
    out = found.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), covered(F.col("starts")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", spans(F.col("starts")).alias("spans"), "copies",
    )
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents of which more than the share ``most`` of the words is hit."""
    found = contamination(docs, benchmark, n, id_col, text_col)
    own, bad_id, bad_hash = fresh(docs, "own_hash", "bad_id", "bad_hash")
    bad = found.where(F.col("contaminated") & (F.col("n_hit") > most * F.col("n_words"))).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    hashed = docs.withColumn(own, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_hash))
    return hashed.join(bad, same, "left_anti").drop(own)
