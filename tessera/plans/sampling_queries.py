"""Samples under rules, stratified counts, contexts and free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import generate, sampling
from tessera.session import checkpoints
from tessera.sources.tables import read, tpc, tpc_graph

from .registry import query

RULES = ["l_discount <= 5%", "l_quantity >= 10"]


@query("accepted_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount <= 0.05 AND l_quantity >= 10")
def accepted_rows(spark, sf_dir):
    return sampling.accepted(read(spark, sf_dir, "lineitem"), RULES).select("l_orderkey", "l_linenumber", "l_partkey")


def _sampled(mode: str):
    def fn(spark, sf_dir):
        checkpoints(spark)
        model = generate.fit(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
        made, _ = sampling.with_rules(spark, model, 1_000, RULES, mode, seed=4)
        return made.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("l_discount") > 0.05) | (F.col("l_quantity") < 10)).alias("broken"))

    return fn


for _mode in ("reject", "hybrid"):
    query(f"sample_{_mode}", "SELECT CAST(1000 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken")(_sampled(_mode))


@query("naive_or_enforced")
def naive_or_enforced(spark, sf_dir):
    checkpoints(spark)
    lines = read(spark, sf_dir, "lineitem")
    return sampling.compare(spark, generate.fit(lines, ["l_quantity", "l_discount"]), lines, 1_000, RULES, seed=4)


@query("stratified_children")
def stratified_children(spark, sf_dir):
    t, key = tpc(spark, sf_dir, "customer", "orders"), tpc_graph("customer", "orders").keys[0]
    attribute, learned = sampling.stratified_counts(t["orders"], t["customer"], key, ["c_mktsegment"], least_effect=0.0)
    made = sampling.child_counts_by(t["customer"], "c_custkey", attribute, learned, 3, "orders")
    return made.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("parents"), F.round(F.avg("children"), 4).alias("mean"))


@query("context_encoding", """
WITH j AS (SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT *, (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2) / count(*) OVER () AS pct FROM j)
SELECT o_orderkey, round(avg(pct) OVER (PARTITION BY c_mktsegment), 6) AS ctx FROM r
""")
def context_encoding(spark, sf_dir):
    t = tpc(spark, sf_dir, "customer", "orders")
    made = sampling.encoded_context(t["orders"], t["customer"], [("o_custkey", "c_custkey")], ["c_mktsegment"], "o_totalprice")
    return made.select("o_orderkey", F.round("ctx_c_mktsegment", 6).alias("ctx"))


@query("content_moods", "SELECT CASE WHEN p_size % 5 + 1 >= 4 THEN 'positive' WHEN p_size % 5 + 1 <= 2 THEN 'negative' ELSE 'neutral' END AS mood, count(*) AS n FROM part GROUP BY 1")
def content_moods(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("rating", F.col("p_size") % 5 + 1)
    made = sampling.content(part, "review", "p_name", "rating", "p_partkey", seed=1)
    mood = F.when(F.col("text").rlike("happy|hoped|Great"), "positive").when(F.col("text").rlike("broke|not buy"), "negative").otherwise("neutral")
    return made.groupBy(mood.alias("mood")).agg(F.count(F.lit(1)).alias("n"))


@query("candidate_repair", """
WITH f AS (SELECT o_orderstatus AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, v)
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'P' THEN (SELECT v FROM f WHERE v <> 'P' LIMIT 1) ELSE o_orderstatus END AS o_orderstatus FROM orders
""")
def candidate_repair(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return sampling.candidate_search(orders, "o_orderstatus", ["o_totalprice <= 300000 or o_orderstatus != 'P'"]).select("o_orderkey", "o_orderstatus")
