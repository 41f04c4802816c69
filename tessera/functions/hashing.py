"""Randomness as a function of seed, stream and row id: the same whatever the partitioning.

The uniform is the first 52 bits of an MD5, so that any SQL engine can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, row_id: Column) -> Column:
    """A double in [0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), row_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: int, stream: str, row_id: str) -> str:
    """The same in DuckDB."""
    return f"CAST(('0x' || substr(md5('{seed}:{stream}:' || CAST({row_id} AS VARCHAR)), 1, 13)) AS BIGINT) / {float(1 << 52)}"


def gaussian(seed: int, stream: str, row_id: Column) -> Column:
    """A standard normal by Box and Muller from two uniforms."""
    a = F.greatest(uniform(seed, stream + "/a", row_id), F.lit(2.0**-52))
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * uniform(seed, stream + "/b", row_id))


def integer(seed: int, stream: str, row_id: Column, low: int, high: int) -> Column:
    """An integer from ``low`` to ``high``, both included."""
    return (F.floor(uniform(seed, stream, row_id) * (high - low + 1)) + low).cast("long")


def by_share(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose part of [0, 1), in list order and by weight, holds ``u``."""
    edges, mass, total = [], 0.0, sum(weights)
    for w in weights[:-1]:
        mass += w / total
        edges.append(mass)
    if len(values) > 32:  # a search in an array, not a branch for each value
        return F.element_at(F.array(*map(F.lit, values)), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= u)) + 1)
    out = None
    for value, edge in zip(values, edges, strict=False):
        out = F.when(u < edge, F.lit(value)) if out is None else out.when(u < edge, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def pick(seed: int, stream: str, row_id: Column, values: list, weights: list[float] | None = None) -> Column:
    """One of ``values``, by weight."""
    return by_share(uniform(seed, stream, row_id), values, weights or [1.0] * len(values))


def poisson(u: Column, lam: float) -> Column:
    """Inverse CDF of a Poisson variable, up to where its upper tail is below 2**-52, the grain of ``u``."""
    if not 0 <= lam <= 500:
        raise ValueError("means from 0 to 500 only")
    p = mass = math.exp(-lam)
    out, k = None, 0
    while k <= lam or p > 2.0**-54:
        out = F.when(u < mass, F.lit(k)) if out is None else out.when(u < mass, F.lit(k))
        k += 1
        p *= lam / k
        mass += p
    return out.otherwise(F.lit(k)).cast("int")


def exactly(df, k: int, seed: int, stream: str, row_id: str, few: int = 50_000):
    """Exactly ``k`` rows of ``df``, those of the smallest hashes; ``row_id`` is distinct.

    The ``k``-th hash is found by counts over 4,096 ranges of it, then over 4,096 parts of the range that
    holds it, until a range holds ``few`` rows: only those are sorted. The rows are then a filter.
    """
    if k <= 0:
        return df.limit(0)
    bits = F.floor(uniform(seed, stream, F.col(f"`{row_id}`")) * float(1 << 52)).cast("long")
    hashed = df.select(bits.alias("h"), F.col(f"`{row_id}`").alias("id"))
    left, shift, rank = hashed, 52, k
    while True:
        shift -= 12
        sizes = sorted((r["b"], r["count"]) for r in left.groupBy(F.shiftright("h", shift).alias("b")).count().collect())
        for bucket, n in sizes:
            if rank <= n:
                break
            rank -= n
        else:
            return df
        left = hashed.where(F.shiftright("h", shift) == bucket)
        if n <= few or shift <= 4:
            last = left.orderBy("h", "id").limit(rank).agg(F.max(F.struct("h", "id")).alias("e")).first()["e"]
            return df.where((bits < last["h"]) | ((bits == last["h"]) & (F.col(f"`{row_id}`") <= F.lit(last["id"]))))
