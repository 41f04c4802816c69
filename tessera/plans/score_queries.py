"""Scores over halves of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational, relations, scoring, stats
from tessera.sources.tables import read, tpc, tpc_graph

from .registry import example, query


def halves(spark, sf_dir, table, key, *columns):
    df = read(spark, sf_dir, table)
    return tuple(df.where(F.col(key) % 2 == i).select(*columns) for i in (0, 1))


def _ks(c: str) -> str:
    return f"(SELECT round(100 * (1 - max(abs(ca / ta - cb / tb))), 4) FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (SELECT {c} AS v, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)))"


@query("fidelity_columns", f"""
SELECT 'o_totalprice' AS "column", 'numeric' AS kind, {_ks('o_totalprice')} AS score UNION ALL SELECT 'o_orderdate', 'numeric', {_ks('o_orderdate')}
UNION ALL SELECT 'o_orderstatus', 'category', (SELECT round(100 * (1 - sum(abs(a / ta - b / tb)) / 2), 4) FROM (SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)))
""")
def fidelity_columns(spark, sf_dir):
    a, b = halves(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    found = scoring.column_scores(a, b)
    return spark.createDataFrame([(c, v["kind"], v["score"]) for c, v in found.items()], "column string, kind string, score double")


@query("edge_coverage", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders WHERE o_orderkey % 2 = 0)
SELECT 'o_totalprice' AS "column", f AS feature, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0 AND ok) AS BIGINT) AS in_real, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1 AND ok) AS BIGINT) AS in_synthetic
FROM (SELECT o_orderkey, unnest(['low_tail', 'high_tail', 'zero', 'negative', 'null']) AS f, unnest([o_totalprice <= lo, o_totalprice >= hi, o_totalprice = 0, o_totalprice < 0, o_totalprice IS NULL]) AS ok FROM orders, q) GROUP BY 2
UNION ALL SELECT 'o_orderstatus', 'null', 0, 0
UNION ALL SELECT 'o_orderstatus', 'rare_categories', 0, 0
""")
def edge_coverage(spark, sf_dir):
    return scoring.edge_coverage(*halves(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"))


@query("relation_cardinality", """
WITH c AS (SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS a, count(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
k AS (SELECT v, sum(x) AS a, sum(y) AS b FROM (SELECT a AS v, 1 AS x, 0 AS y FROM c UNION ALL SELECT b, 0, 1 FROM c) GROUP BY 1)
SELECT 'cardinality' AS part, round(100 * (1 - sum(abs(a / ta - b / tb)) / 2), 4) AS score FROM (SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM k)
UNION ALL SELECT 'join_size', round(100 * (1 - abs(avg(a) - avg(b)) / greatest(avg(a), avg(b))), 4) FROM c
""")
def relation_cardinality(spark, sf_dir):
    t = tpc(spark, sf_dir, "customer", "orders")
    sides = [{"customer": t["customer"].select("c_custkey"), "orders": t["orders"].where(F.col("o_orderkey") % 2 == i).select("o_orderkey", "o_custkey")} for i in (0, 1)]
    found = scoring.relation_metrics(*sides, tpc_graph("customer", "orders"))
    return spark.createDataFrame([(p, round(found["parts"][p], 4)) for p in ("cardinality", "join_size")], "part string, score double")


@query("fidelity_report")
def fidelity_report(spark, sf_dir):
    found = scoring.fidelity(*halves(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice", "p_brand"))
    return spark.createDataFrame([("score", found["score"])] + [(k, v) for k, v in found["parts"].items()], "part string, value double")


@query("privacy_report")
def privacy_report(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("__id"), "p_size", "p_retailprice", "p_brand")
    found = scoring.privacy(part.where("__id % 3 = 0"), part.where("__id % 3 = 1"), part.where("__id % 3 = 2"))
    return spark.createDataFrame([("score", float(found["score"])), ("auc", float(found["auc"]))] + [(k, float(v)) for k, v in found["parts"].items()], "part string, value double")


@query("tstr_report")
def tstr_report(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.substring("p_type", 1, 3).alias("kind"))
    rows = [part.where(F.col("p_partkey") % 3 == i).drop("p_partkey") for i in range(3)]
    found = scoring.tstr(rows[0], rows[1], rows[2], "p_retailprice")
    return spark.createDataFrame([(n, float(m["real"]["r2"]), float(m["synthetic"]["r2"])) for n, m in found["models"].items()], "model string, real double, synthetic double")


@example("trust_report", "SELECT CAST(81.0 AS DOUBLE) AS score, 'good' AS band")
def trust_report(spark, sf_dir):
    found = scoring.trust(90.0, 75.0, 75.0)
    return spark.createDataFrame([(found["score"], found["band"])], "score double, band string")


# lines against their orders, parts, suppliers and customers: every group effect and rank correlation
_GROUPS = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment")]
_NUMBERS = [("orders", "o_totalprice"), ("part", "p_size"), ("part", "p_retailprice"), ("supplier", "s_acctbal"), ("customer", "c_acctbal")]
_LINES = "lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN customer ON c_custkey = o_custkey"


def _eta2_sql(table: str, column: str, y: str) -> str:
    groups = f"SELECT {column} AS g, count({y}) AS n, sum({y}) AS s, sum({y} * {y}) AS q FROM wide WHERE {column} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1"
    return f"SELECT 'group' AS kind, '{y}' AS child_column, '{table}' AS ancestor, '{column}' AS ancestor_column, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS effect FROM ({groups})"


def _rank_sql(table: str, column: str, y: str) -> str:
    mean = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return f"SELECT 'rank', '{y}', '{table}', '{column}', round(corr(a, b), 6) FROM (SELECT {mean(column)} AS a, {mean(y)} AS b FROM wide)"


@query("cross_effects", f"WITH wide AS (SELECT * FROM {_LINES}) " + " UNION ALL ".join([_eta2_sql(t, c, y) for t, c in _GROUPS for y in ("l_quantity", "l_extendedprice")] + [_rank_sql(t, c, y) for t, c in _NUMBERS for y in ("l_quantity", "l_extendedprice")]))
def cross_effects(spark, sf_dir):
    names = ("lineitem", "orders", "part", "supplier", "customer")
    tables, graph = tpc(spark, sf_dir, *names), tpc_graph(*names)
    picked = {"lineitem": ["l_quantity", "l_extendedprice"], "orders": ["o_orderstatus", "o_orderpriority", "o_totalprice"], "part": ["p_size", "p_retailprice"], "supplier": ["s_acctbal"], "customer": ["c_mktsegment", "c_acctbal"]}
    few = {"o_orderstatus", "o_orderpriority", "c_mktsegment"}
    known = {t: {c: 5 if c in few else relational.STRATA_VALUES + 1 for c in cs} for t, cs in picked.items()}
    found = relations.effects(tables, graph, "lineitem", known, {t: relations.ANCESTOR_ROWS for t in names})
    rows = [(e.kind, e.child_column, e.ancestor, e.ancestor_column, round(e.value, 6)) for e in found]
    return spark.createDataFrame(rows, "kind string, child_column string, ancestor string, ancestor_column string, effect double")


# return flags guessed from three scores of a line
_SCORES = {"A": "l_discount", "N": "l_quantity / 50", "R": "l_tax * 4"}


@query("classification_metrics", f"""
WITH s AS (SELECT l_returnflag AS y, {', '.join(f'{e} AS s{k}' for k, e in _SCORES.items())} FROM lineitem
), g AS (SELECT *, CASE WHEN sA >= sN AND sA >= sR THEN 'A' WHEN sN >= sR THEN 'N' ELSE 'R' END AS p FROM s
), f AS (SELECT k, 2 * count(*) FILTER (WHERE y = k AND p = k) / (count(*) FILTER (WHERE y = k) + count(*) FILTER (WHERE p = k)) AS f1 FROM g, (SELECT unnest(['A', 'N', 'R']) AS k) GROUP BY k)
SELECT 'accuracy' AS metric, round(avg(CAST(y = p AS DOUBLE)), 9) AS value FROM g UNION ALL SELECT 'macro_f1', round(avg(f1), 9) FROM f
""" + "".join(f" UNION ALL SELECT 'auc_{k}', round((sum(r) FILTER (WHERE y = '{k}') - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * (count(*) - any_value(p))), 9) FROM (SELECT y, rank() OVER (ORDER BY s{k}) + (count(*) OVER (PARTITION BY s{k}) - 1) / 2 AS r, count(*) FILTER (WHERE y = '{k}') OVER () AS p FROM s)" for k in _SCORES))
def classification_metrics(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", *[F.expr(e).alias(f"s{k}") for k, e in _SCORES.items()])
    said = lines.withColumn("said", F.expr("CASE WHEN sA >= sN AND sA >= sR THEN 'A' WHEN sN >= sR THEN 'N' ELSE 'R' END"))
    areas = stats.auc_by_class(lines, "l_returnflag", list(_SCORES), {k: F.col(f"s{k}") for k in _SCORES})
    found = stats.confusion(said, "l_returnflag", "said") | {f"auc_{k}": v for k, v in areas.items()}
    return spark.createDataFrame([(k, round(v, 9)) for k, v in found.items()], "metric string, value double")
