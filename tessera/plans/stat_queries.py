"""Statistics, inference and cardinality over the driver tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import inference, neighbours, stats
from tessera.sources.tables import read, shop, shop_sql, tpc, tpc_graph

from .registry import example, query


@query("describe", "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe(spark, sf_dir):
    found = stats.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("column", "n", *[F.round(c, 6).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean", "std")])


@query("null_rates", "SELECT 'c_acctbal' AS \"column\", count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) / count(*) AS rate FROM (SELECT nullif(c_nationkey, 3) AS v FROM customer)")
def null_rates(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("c_acctbal"))
    return stats.null_rates(df)


@query("quantile_grid", "SELECT i / 20 AS p, round(quantile_cont(l_extendedprice, i / 20), 6) AS value FROM lineitem, (SELECT unnest(range(0, 21)) AS i) GROUP BY i")
def quantile_grid(spark, sf_dir):
    return stats.quantile_grid(read(spark, sf_dir, "lineitem"), "l_extendedprice", 21).select("p", F.round("value", 6).alias("value"))


ORACLE_GRID = "SELECT i / 20 AS p, round(v, 6) AS value FROM (SELECT unnest(range(0, 21)) AS i, unnest(q) AS v FROM (SELECT quantile_cont(l_extendedprice, [x / 20 for x in range(0, 21)]) AS q FROM lineitem))"
query("quantile_grid", ORACLE_GRID)(quantile_grid)


@query("iqr_bounds", "SELECT round(q[1] - 1.5 * (q[2] - q[1]), 6) AS low, round(q[2] + 1.5 * (q[2] - q[1]), 6) AS high FROM (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders)")
def iqr_bounds(spark, sf_dir):
    quarters = stats.even_quantiles(read(spark, sf_dir, "orders"), "o_totalprice", 4)
    made = quarters.agg(F.max(F.when(F.col("i") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("i") == 3, F.col("value"))).alias("b"))
    spread = F.col("b") - F.col("a")
    return made.select(F.round(F.col("a") - 1.5 * spread, 6).alias("low"), F.round(F.col("b") + 1.5 * spread, 6).alias("high"))


@query("hist_numeric", "SELECT CAST(least(10, greatest(1, floor((l_quantity - 0) / (50 / 10)) + 1)) AS INTEGER) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 1")
def hist_numeric(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "lineitem"), "l_quantity", 10, 0.0, 50.0).withColumn("share", F.round("share", 9))


@query("hist_date", "SELECT CAST(least(12, greatest(1, floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) / ((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(TIMESTAMP '1992-01-01')) / 12)) + 1)) AS INTEGER) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def hist_date(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    low, high = 694224000 * 1_000_000, 915148800 * 1_000_000
    return stats.histogram(df, "t", 12, float(low), float(high)).withColumn("share", F.round("share", 9))


@query("freq_topk_other", """
WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), t AS (SELECT value FROM c WHERE n >= 5 ORDER BY n DESC, value LIMIT 3)
SELECT value, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (), 9) AS share FROM (SELECT CASE WHEN value IN (SELECT value FROM t) THEN value ELSE 'other' END AS value, n FROM c) GROUP BY value
""")
def freq_topk_other(spark, sf_dir):
    return stats.frequencies(read(spark, sf_dir, "part"), "p_type", 3, 5).withColumn("share", F.round("share", 9))



def halves(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'"), lines.where("l_returnflag <> 'R'")


@query("ks_two_sample", """
WITH v AS (SELECT l_extendedprice AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1)
SELECT round(max(abs(ca / ta - cb / tb)), 9) AS statistic, CAST(max(ta) AS BIGINT) AS n_a, CAST(max(tb) AS BIGINT) AS n_b
FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM v)
""")
def ks_two_sample(spark, sf_dir):
    return stats.ks(*halves(spark, sf_dir), "l_extendedprice").withColumn("statistic", F.round("statistic", 9))


_TWO = "(SELECT CAST(l_linenumber AS VARCHAR) AS value, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1)"


@query("tvd_two_sample", f"SELECT round(sum(abs(a / ta - b / tb)) / 2, 9) AS tvd FROM (SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM {_TWO})")
def tvd_two_sample(spark, sf_dir):
    return stats.tvd(*halves(spark, sf_dir), "l_linenumber").select(F.round("tvd", 9).alias("tvd"))


@query("chi2_two_sample", f"SELECT round(sum((b - a / ta * tb) ** 2 / (a / ta * tb)), 6) AS chi2, count(*) - 1 AS dof, round(max(abs(a / ta - b / tb)), 9) AS max_gap FROM (SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM {_TWO} WHERE a > 0)")
def chi2_two_sample(spark, sf_dir):
    found = stats.chi_square(*halves(spark, sf_dir), "l_linenumber")
    return found.select(F.round("chi2", 6).alias("chi2"), "dof", F.round("max_gap", 9).alias("max_gap"))


@query("spearman_pair", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part)
SELECT round(corr(x, y), 9) AS rho FROM r
""")
def spearman_pair(spark, sf_dir):
    return stats.spearman(read(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("rho", 9).alias("rho"))


@query("corr_matrix_long", "\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def corr_matrix_long(spark, sf_dir):
    return stats.correlations(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 9))


@query("eta2_segment", """
WITH j AS (SELECT c_mktsegment AS g, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT avg(v) AS mu, sum((v - (SELECT avg(v) FROM j)) ** 2) AS tot FROM j)
SELECT round(sum(n * (a - mu) ** 2) / any_value(tot), 9) AS eta2 FROM (SELECT g, count(*) AS n, avg(v) AS a FROM j GROUP BY g), m
""")
def eta2_segment(spark, sf_dir):
    j = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.eta2(j, "c_mktsegment", "o_totalprice").select(F.round("eta2", 9).alias("eta2"))


@query("auc_rank_sum", """
WITH j AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM j)
SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)), 9) AS auc FROM r
""")
def auc_rank_sum(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return stats.auc(j, "n_chars", "quality").select(F.round("auc", 9).alias("auc"))


@example("nn_distance", """
SELECT q.vec_id AS id, round(min(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6) AS distance
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.label = 0 GROUP BY 1
""")
def nn_distance(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows.where("label = 0"), rows, "vec_id", "embedding").select("id", F.round("distance", 6).alias("distance"))


@query("nn_distance_all", """
SELECT q.vec_id AS id, round(min(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6) AS distance
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id GROUP BY 1
""")
def nn_distance_all(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows, "vec_id", "embedding").select("id", F.round("distance", 6).alias("distance"))


@query("key_stats", "\nUNION ALL\n".join(f"SELECT '{v}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM {shop_sql(v)}" for v, cols in (("customers", ("customer_id", "name", "nation_id", "segment")), ("nations", ("nation_id", "name", "region_id"))) for c in cols))
def key_stats(spark, sf_dir):
    return inference.key_stats(shop(spark, sf_dir, "customers", "nations"))


@query("infer_graph", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', '{p}', '{k}')" for c, k, p in (("orders", "customer_id", "customers"), ("order_items", "order_id", "orders"), ("order_items", "product_id", "products"), ("order_items", "supplier_id", "suppliers"), ("customers", "nation_id", "nations"), ("suppliers", "nation_id", "nations"), ("nations", "region_id", "regions"))) + ") AS t(child, child_column, parent, parent_column)")
def infer_graph(spark, sf_dir):
    graph = inference.infer(shop(spark, sf_dir))
    return spark.createDataFrame([(k.child, ",".join(k.columns), k.parent, ",".join(k.parent_columns)) for k in graph.keys], "child string, child_column string, parent string, parent_column string")


@query("cardinality_stats", """
SELECT 'orders(o_custkey)->customer(c_custkey)' AS key, count(*) AS parents, round(avg(n), 9) AS mean, max(n) AS max, round(avg(CAST(n = 0 AS DOUBLE)), 9) AS zero_fraction, CAST(0 AS DOUBLE) AS null_rate, CASE WHEN max(n) <= 1 THEN '1:1' ELSE '1:N' END AS cardinality
FROM (SELECT c_custkey, count(o_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
""")
def cardinality_stats(spark, sf_dir):
    t, key = tpc(spark, sf_dir, "orders", "customer"), tpc_graph("orders", "customer").keys[0]
    return inference.cardinality(t["orders"], t["customer"], key).withColumns({c: F.round(c, 9) for c in ("mean", "zero_fraction")})


@query("children_hist", "SELECT least(n, 10) AS children, count(*) AS parents FROM (SELECT c_custkey, count(o_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1")
def children_hist(spark, sf_dir):
    t, key = tpc(spark, sf_dir, "orders", "customer"), tpc_graph("orders", "customer").keys[0]
    return inference.children_histogram(t["orders"], t["customer"], key)


@query("join_path_size", "SELECT 'lineitem->nation' AS path, count(*) AS rows, (SELECT count(*) FROM nation) AS ancestors, round(count(*) / (SELECT count(*) FROM nation), 9) AS per_ancestor FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_path_size(spark, sf_dir):
    names = ("lineitem", "orders", "customer", "nation")
    return inference.path_size(tpc(spark, sf_dir, *names), tpc_graph(*names), "lineitem", "nation").withColumn("per_ancestor", F.round("per_ancestor", 9))


_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_SETS = [c for n in (2, 3) for c in combinations(_KEYS, n)]
_quoted = lambda c: ", ".join(f"'{x}'" for x in c)


@query("unique_sets", "WITH u AS (" + " UNION ALL ".join(f"SELECT [{_quoted(c)}] AS s, count(DISTINCT ({', '.join(c)})) = count(*) AS ok FROM lineitem" for c in _SETS) + ") SELECT array_to_string(s, ',') AS columns FROM u WHERE ok AND NOT EXISTS (SELECT 1 FROM u v WHERE v.ok AND len(v.s) < len(u.s) AND list_has_all(u.s, v.s))")
def unique_sets(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    distinct = lines.agg(*[F.count_distinct(c).alias(c) for c in _KEYS]).first().asDict()
    found = inference.unique_sets(lines, distinct)
    return spark.createDataFrame([(",".join(c),) for c in found], "columns string")
