"""The event operators on unbounded input. The batch forms are the same expressions, so results agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None, time: str = "ts") -> DataFrame:
    """start, event_type, n, total per window; with ``late``, state older than the watermark is dropped."""
    df = events.withColumn("__t", F.col(time).cast("timestamp"))
    if late:
        df = df.withWatermark("__t", late)
    made = df.groupBy(F.window("__t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, time: str = "ts") -> DataFrame:
    """user_id, start, end, n per run of events without a longer gap."""
    df = events.withColumn("__t", F.col(time).cast("timestamp"))
    if late:
        df = df.withWatermark("__t", late)
    made = df.groupBy("user_id", F.session_window("__t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def flagged(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a row rule, with the names of the rules; stateless, so it streams as it is."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return events.withColumn("broken", broken).where(F.size("broken") > 0)


def stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result table."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
