"""Queries of relational generation: popularity, strata and junctions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform_sql
from tessera.operators import inference, relational
from tessera.plans.registry import query
from tessera.schema import ForeignKey, Graph, Table
from tessera.session import checkpoints
from tessera.sources.tables import read, tpc, tpc_graph

SUPPLIED = ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",))


@query("popular_references", f"""
WITH counts AS (SELECT v, count(*) AS n FROM (SELECT s_suppkey, count(l_suppkey) AS v FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) GROUP BY 1
), placed AS (SELECT v, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM counts
), weighed AS (SELECT s_suppkey, 10 * v + 1 AS w FROM (SELECT s_suppkey, floor({uniform_sql(5, 'popular/x', 's_suppkey')} * (SELECT sum(n) FROM counts)) AS pos FROM supplier) JOIN placed ON pos >= b AND pos < b + n
), ranged AS (SELECT s_suppkey, w, coalesce(sum(w) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM weighed)
SELECT o_orderkey, s_suppkey AS partner FROM (SELECT o_orderkey, floor({uniform_sql(5, 'ref/x', 'o_orderkey')} * (SELECT sum(w) FROM weighed)) AS pos FROM orders) JOIN ranged ON pos >= b AND pos < b + w
""")
def popular_references(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier")
    learned = relational.counts_of(inference.children(read(spark, sf_dir, "lineitem"), suppliers, SUPPLIED))
    weights = relational.popularity(suppliers.select(F.col("s_suppkey").alias("__id")), relational.parts(learned, "v", "n"), 5, "x")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("__id"))
    return relational.by_popularity(rows, weights, 5, "x", "partner").withColumnRenamed("__id", "o_orderkey")


@query("children_by_stratum", """
WITH counted AS (SELECT c_custkey, c_mktsegment, r_name, count(o_orderkey) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ALL
), melted AS (SELECT 'c_mktsegment' AS a, c_mktsegment AS g, v FROM counted UNION ALL SELECT 'r_name', r_name, v FROM counted
), effect AS (SELECT a, sum(n * (m - t) * (m - t)) / any_value(q) AS e FROM (SELECT a, g, count(*) AS n, avg(v) AS m FROM melted WHERE g IS NOT NULL GROUP BY 1, 2), (SELECT avg(v) AS t, var_pop(v) * count(*) AS q FROM counted) GROUP BY a
), best AS (SELECT a, e FROM effect ORDER BY e DESC, a LIMIT 1)
SELECT a AS attribute, round(e, 9) AS effect, g AS value, CAST(v AS BIGINT) AS children, count(*) AS parents FROM melted JOIN best USING (a) WHERE g IS NOT NULL GROUP BY ALL
""")
def children_by_stratum(spark, sf_dir):
    checkpoints(spark)
    names = ("customer", "orders", "nation", "region")
    tables, graph = tpc(spark, sf_dir, *names), tpc_graph(*names)
    known = {t: relational.attributes(graph, t, tables[t]) for t in names}
    key = next(k for k in graph.keys if k.child == "orders")
    found = relational.stratify(key, tables, graph, known, least=0.0)
    return found.placed.select(F.lit(found.column).alias("attribute"), F.lit(round(found.effect, 9)).alias("effect"), F.col("g").alias("value"), F.col("v").alias("children"), F.col("n").alias("parents"))


def offers(spark, sf_dir) -> tuple[dict[str, DataFrame], Graph]:
    """Parts, suppliers and which supplier offers which part, as the lines of orders show it."""
    tables = tpc(spark, sf_dir, "part", "supplier")
    tables["offers"] = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    keys = [ForeignKey("offers", ("l_partkey",), "part", ("p_partkey",), nullable=False), ForeignKey("offers", ("l_suppkey",), "supplier", ("s_suppkey",), nullable=False)]
    return tables, Graph([Table("part", {}, ("p_partkey",)), Table("supplier", {}, ("s_suppkey",)), Table("offers", {}, ("l_partkey", "l_suppkey"))], keys)


@query("junction_generation", """
WITH pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT 'part' AS "table", count(*) AS rows, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS faults FROM part
UNION ALL SELECT 'supplier', count(*), 0, 0 FROM supplier UNION ALL SELECT 'offers', count(*), 0, 0 FROM pairs
""")
def junction_generation(spark, sf_dir):
    """Rows, repeated keys and key faults of a generated junction with as many pairs as the real one."""
    tables, graph = offers(spark, sf_dir)
    made = relational.generate_all(relational.fit(tables, graph), rows={"offers": tables["offers"].count()}, seed=6)
    found = made.integrity().select("on", "count").collect()  # a row for each key and kind of fault
    rows = []
    for t, df in made.tables.items():
        n = df.count()
        rows.append((t, n, n - df.select(*graph.tables[t].key).distinct().count(), sum(r["count"] for r in found if r["on"].startswith(t))))
    return spark.createDataFrame(rows, "`table` string, rows long, repeated long, faults long")
