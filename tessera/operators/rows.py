"""Row-order operators: duplicates, numbering, running values, exact top-k, set operations, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators.stats import kth_smallest


def repeats(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """``df`` with ``repeated``: second and later rows of a key (``first``), or all of a repeated key (``none``)."""
    part = Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
    if keep == "none":
        return df.withColumn("repeated", F.count(F.lit(1)).over(part) > 1)
    return df.withColumn("repeated", F.row_number().over(part.orderBy(*order)) > 1)


def numbered(df: DataFrame, parent: str, order: list[str], name: str = "line") -> DataFrame:
    """Running number from 1 within each parent."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def running_balance(df: DataFrame, account: str, order: list[str], amount: Column, opening: float = 0.0) -> DataFrame:
    """``balance`` after each row of an account."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("balance", F.lit(opening) + F.sum(amount).over(w))


def balance_gaps(df: DataFrame, account: str, seq: str, amount: Column, balance: str, tolerance: float = 0.005) -> DataFrame:
    """Rows whose balance does not continue the one before; only consecutive numbers are compared."""
    w = Window.partitionBy(account).orderBy(seq)
    off = F.abs(F.lag(balance).over(w) + amount - F.col(balance)) > tolerance
    return df.withColumn("__gap", (F.col(seq) - F.lag(seq).over(w) == 1) & off).where("__gap").drop("__gap")


def first_last(df: DataFrame, account: str, seq: str, value: str) -> DataFrame:
    """account, opening, closing: the values at the smallest and largest ``seq``; no sort."""
    return df.groupBy(account).agg(F.min_by(value, seq).alias("opening"), F.max_by(value, seq).alias("closing"))


def flag_top(df: DataFrame, score: Column, rate: float, row_id: str, name: str = "flag") -> DataFrame:
    """Exactly round(rate * n) rows flagged, highest scores first, nulls last, ties by ``row_id``, a distinct number.

    The last score that counts is found by narrowing ranges; the flag is then a comparison, so no row moves.
    """
    n, scores = df.agg(F.count(F.lit(1)), F.count(score)).first()
    k = int(rate * n + 0.5)
    scored = df.withColumn("__s", score)
    if k == 0:
        return scored.withColumn(name, F.lit(False)).drop("__s")
    if k <= scores:
        least, better = kth_smallest(scored.select((-F.col("__s").cast("double")).alias("__s")), "__s", k)
        above, tied = F.col("__s").cast("double") > F.lit(-least), F.col("__s").cast("double") == F.lit(-least)
    else:
        better, above, tied = scores, F.col("__s").isNotNull(), F.col("__s").isNull()
    last, _ = kth_smallest(scored.where(tied).select(row_id), row_id, k - better)
    return scored.withColumn(name, F.coalesce(above, F.lit(False)) | F.coalesce(tied & (F.col(row_id) <= F.lit(last)), F.lit(False))).drop("__s")


def spread_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """``k`` rows at even places of ``order`` (a dense number from 0)."""
    n = df.count()
    if n <= k:
        return df
    places = [round(i * (n - 1) / (k - 1)) for i in range(k)]
    return df.where(F.col(order).isin(places))


def changed(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """column, changed: rows of both versions whose values differ, by column."""
    cols = [c for c in before.columns if c in after.columns and c != row_id]
    b = after.select(row_id, *[F.col(f"`{c}`").alias(f"__{c}") for c in cols])
    counts = before.join(b, row_id).agg(*[F.count_if(~F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`"))).alias(c) for c in cols])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("changed")) for c in cols])))


def drop_with_children(tables: dict[str, DataFrame], parent: str, keys: DataFrame, key: str, children: dict[str, str]) -> dict[str, DataFrame]:
    """Parent rows whose key is in ``keys`` go, with their rows in ``children`` (table -> key column)."""
    out = {parent: tables[parent].join(keys.select(key), key, "left_anti")}
    for t, c in children.items():
        out[t] = tables[t].join(keys.select(F.col(key).alias(c)), c, "left_anti")
    return tables | out


def exact_copies(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows of ``synthetic`` that equal a row which ``real`` has once, and chance repeats within ``real``."""
    def keyed(df: DataFrame) -> DataFrame:
        parts = [F.coalesce((F.round(c, 6) if t in ("double", "float") else F.col(c)).cast("string"), F.lit("\0")) for c, t in df.select(*columns).dtypes]
        return df.select(F.md5(F.concat_ws("\x1f", *parts).cast("binary")).alias("k"))

    known = keyed(real).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hit = keyed(synthetic).groupBy("k").agg(F.count(F.lit(1)).alias("m")).join(known.where("n = 1"), "k").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("copies"))
    chance = known.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"), F.sum("n").alias("rows"))
    return hit.crossJoin(F.broadcast(chance))


def select_only(spark, sql: str) -> DataFrame:
    """Run a query of the user; anything but a query is refused by its parsed plan, not by words in it."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    name = plan.getClass().getSimpleName()
    if name.endswith("Command") or name in {"InsertIntoStatement", "CreateTable", "CreateTableAsSelect", "DropTable", "DeleteFromTable", "UpdateTable", "MergeIntoTable", "CreateView", "ReplaceTable", "AlterColumns", "SetCatalogAndNamespace", "CreateNamespace", "DropNamespace", "DropView", "CacheTable", "UncacheTable", "RefreshTable", "LoadData", "TruncateTable"}:
        raise ValueError(f"only queries are allowed, not {name}")
    return spark.sql(sql)


def pairs_of_entities(records: DataFrame, entity: str, record: str, name: str, n_negative: int = 0, seed: int = 0) -> DataFrame:
    """a, b, label: pairs of records of one entity (1), and of one name but different entities (0).

    Both are equi-joins on their key and return every pair, so entities and names should be small groups.
    ``n_negative`` more pairs of different entities and names are drawn by hash: the records, dealt in a random
    order, are paired with the next one in it.
    """
    a = records.select(F.col(entity).alias("e1"), F.col(record).alias("a"), F.lower(F.trim(name)).alias("n1"))
    b = records.select(F.col(entity).alias("e2"), F.col(record).alias("b"), F.lower(F.trim(name)).alias("n2"))
    same = a.join(b, (F.col("e1") == F.col("e2")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1).alias("label"))
    alike = a.join(b, (F.col("n1") == F.col("n2")) & (F.col("a") < F.col("b")) & (F.col("e1") != F.col("e2"))).select("a", "b", F.lit(0).alias("label"))
    found = same.unionByName(alike)
    if n_negative <= 0:
        return found
    # a random order, cut into ranges of the hash; each record meets its next one in its range
    u = hashing.uniform(seed, "negatives", F.col("a"))
    ranges = max(1, records.count() // 1_000)
    order = Window.partitionBy(F.floor(u * ranges)).orderBy(u, "a")
    follow = a.select("a", "e1", "n1", *[F.lead(c).over(order).alias(f"{c}_") for c in ("a", "e1", "n1")])
    far = follow.where("a_ is not null and e1 <> e1_ and not (n1 <=> n1_)").select(F.least("a", "a_").alias("a"), F.greatest("a", "a_").alias("b"))
    key = F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string"))
    drawn = hashing.exactly(far.withColumn("__k", key), n_negative, seed, "negatives/pick", "__k")
    return found.unionByName(drawn.select("a", "b", F.lit(0).alias("label")))


def sampled(df: DataFrame, k: int, seed: int, row_id: str) -> DataFrame:
    """Exactly ``k`` rows without replacement, the same for any partitioning."""
    return hashing.exactly(df, k, seed, "sample", row_id)
