"""Connected components of a link table, wholly distributed.

Alternates two rewrites of the links until nothing changes: each node hands its larger neighbours to
its smallest neighbour, then its smaller ones. Every rewrite is a partially aggregated minimum and
an equi-join, so a node with very many links is split like any skewed join side. Each round is
written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v), both long; root is the smallest node reachable.

    Self-links and repeated links are allowed. Raises if ``rounds`` do not suffice.
    """
    links = written(links.where("u <> v").select("u", "v").distinct(), "links")
    mark = _mark(links)
    for _ in range(rounds):
        links = written(_small(written(_large(links), "links")), "links")
        if (now := _mark(links)) == mark:
            stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
