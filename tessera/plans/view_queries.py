"""Chart payloads, template documents and document batches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import batches, templates, views
from tessera.sources.tables import read, tpc, tpc_graph

from .registry import query


@query("view_distribution", "SELECT bin, round(count(*) FILTER (WHERE h = 0) / sum(count(*) FILTER (WHERE h = 0)) OVER (), 6) AS real, round(count(*) FILTER (WHERE h = 1) / sum(count(*) FILTER (WHERE h = 1)) OVER (), 6) AS synthetic FROM (SELECT l_orderkey % 2 AS h, CAST(least(20, greatest(1, floor((l_quantity - 1) / ((50 - 1.0) / 20)) + 1)) AS INTEGER) AS bin FROM lineitem) GROUP BY 1")
def view_distribution(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    p = views.distribution(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1"), "l_quantity")
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(zip(p["real"], p["synthetic"], strict=True)) if a or b]
    return spark.createDataFrame(rows, "bin int, real double, synthetic double")


@query("view_categorical", "SELECT c_mktsegment AS value, round(count(*) FILTER (WHERE c_custkey % 2 = 0) / sum(count(*) FILTER (WHERE c_custkey % 2 = 0)) OVER (), 6) AS real, round(count(*) FILTER (WHERE c_custkey % 2 = 1) / sum(count(*) FILTER (WHERE c_custkey % 2 = 1)) OVER (), 6) AS synthetic FROM customer GROUP BY 1")
def view_categorical(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    p = views.categorical(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), "c_mktsegment")
    return spark.createDataFrame(list(zip(p["values"], p["real"], p["synthetic"], strict=True)), "value string, real double, synthetic double")


@query("view_cardinality", "SELECT CAST(k AS INTEGER) AS children, count(*) AS parents FROM (SELECT least(count(o_custkey), 10) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY 1")
def view_cardinality(spark, sf_dir):
    t, g = tpc(spark, sf_dir, "customer", "orders"), tpc_graph("customer", "orders")
    p = views.cardinality(t, t, g)["keys"][0]
    return spark.createDataFrame([(i, n) for i, n in enumerate(p["real"]) if n], "children int, parents long")


@query("view_payloads")
def view_payloads(spark, sf_dir):
    c, t = read(spark, sf_dir, "part"), tpc(spark, sf_dir, "customer", "orders")
    a, b = c.where("p_partkey % 2 = 0"), c.where("p_partkey % 2 = 1")
    made = [views.correlation(a, b), views.missing(a, b), views.scores(a.select("p_size", "p_brand"), b.select("p_size", "p_brand")), views.integrity_view(t, tpc_graph("customer", "orders")), views.overview(t)]
    return spark.createDataFrame([(p["type"], len(json.dumps(p)) < views.CEILING) for p in made], "type string, small boolean")


@query("payslip_rules", "SELECT CAST(0 AS BIGINT) AS broken, count(*) AS documents FROM customer")
def payslip_rules(spark, sf_dir):
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    docs = templates.build(ids, templates.PAYSLIP, seed=2)
    broken = templates.broken_rules(docs, templates.PAYSLIP).agg(F.count(F.lit(1)).alias("broken"))
    return broken.crossJoin(docs.agg(F.count(F.lit(1)).alias("documents")))


@query("template_expression", "SELECT c_custkey AS id, CAST(CASE WHEN a > 5000 AND NOT (a > 8000) THEN round(CAST(a AS DECIMAL(14,2)) * CAST(0.05 AS DECIMAL(4,2)), 2) ELSE greatest(a, 10) END AS DOUBLE) AS v FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS a FROM customer)")
def template_expression(spark, sf_dir):
    v = templates.compile_expression("round(pct(a, 5), 2) if a > 5000 and not a > 8000 else max(a, 10)", {"a": F.col("c_acctbal").cast(templates.DECIMAL)})
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), v.cast("double").alias("v"))


@query("document_batch", "SELECT CASE WHEN c_acctbal < 0 OR c_custkey % 10 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN c_acctbal < 0 THEN 'validate' WHEN c_custkey % 10 = 0 THEN 'generate' ELSE 'done' END AS stage, count(*) AS documents FROM customer GROUP BY 1, 2")
def document_batch(spark, sf_dir):
    specs = read(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_acctbal")).alias("spec"))

    def generate(spec):
        if spec["c_custkey"] % 10 == 0:
            raise batches.Transient("busy")
        return {"total": round(spec["c_acctbal"], 2)}

    found = batches.run(specs, lambda s: ["negative"] if s["c_acctbal"] < 0 else [], generate, lambda d: [] if d["total"] >= 0 else ["negative"], retry=batches.Retry(2, 0.0))
    return batches.tally(found)


_PARTS = "SELECT p_partkey, (p_size - (SELECT median(p_size) FROM t)) / (SELECT stddev_pop(p_size) FROM t) AS x, (p_retailprice - (SELECT median(p_retailprice) FROM t)) / (SELECT stddev_pop(p_retailprice) FROM t) AS y FROM part"


@query("view_privacy_distance", f"""
WITH t AS (SELECT * FROM part WHERE p_partkey % 3 = 0), v AS ({_PARTS}
), d AS (SELECT q.p_partkey % 3 AS side, min(sqrt((q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y))) AS d FROM v q, v c WHERE q.p_partkey % 3 > 0 AND c.p_partkey % 3 = 0 GROUP BY q.p_partkey
), b AS (SELECT side, CAST(least(20, floor(d / ((SELECT max(d) FROM d) / 20)) + 1) AS INTEGER) AS bin FROM d)
SELECT bin, round(count(*) FILTER (WHERE side = 1) / (SELECT count(*) FROM d WHERE side = 1), 6) AS synthetic, round(count(*) FILTER (WHERE side = 2) / (SELECT count(*) FROM d WHERE side = 2), 6) AS baseline FROM b GROUP BY bin
""")
def view_privacy_distance(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("__id"), "p_size", "p_retailprice")
    p = views.privacy_distance(*[part.where(F.col("__id") % 3 == i) for i in range(3)])
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(zip(p["synthetic"], p["baseline"], strict=True)) if a or b]
    return spark.createDataFrame(rows, "bin int, synthetic double, baseline double")


@query("view_batch_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 10 > 0) AS succeeded, count(*) FILTER (WHERE c_acctbal < 0) AS at_validate, count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 10 = 0) AS at_generate,
       round(100 * count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 10 > 0) / count(*), 2) AS success_pct FROM customer
""")
def view_batch_summary(spark, sf_dir):
    specs = read(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_acctbal")).alias("spec"))

    def generate(spec):
        if spec["c_custkey"] % 10 == 0:
            raise batches.Transient("busy")
        return {"total": spec["c_acctbal"]}

    p = views.batch_summary(batches.run(specs, lambda s: ["negative"] if s["c_acctbal"] < 0 else [], generate, lambda d: [], retry=batches.Retry(1, 0.0)))
    row = (p["total"], p["succeeded"], p["by_stage"].get("validate", 0), p["by_stage"].get("generate", 0), p["success_pct"])
    return spark.createDataFrame([row], "total long, succeeded long, at_validate long, at_generate long, success_pct double")
