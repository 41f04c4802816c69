"""Datasets, plain language, semantics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.language import multilingual, requests
from tessera.operators import integrity, repair, semantics
from tessera.operators.rules import plain, plans
from tessera.session import checkpoints
from tessera.sources import datasets, sinks, suites
from tessera.sources.tables import read, tpc, tpc_graph
from tessera.streaming import events

from .registry import example, query


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    found = events.tumbling(read(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("events_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def events_sessions(spark, sf_dir):
    found = events.sessions(read(spark, sf_dir, "events"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("events_flagged", "SELECT event_id, CASE WHEN value < 5 THEN 'low' ELSE '' END || CASE WHEN event_type = 'error' THEN 'kind' ELSE '' END AS broken FROM events WHERE value < 5 OR event_type = 'error'")
def events_flagged(spark, sf_dir):
    found = events.flagged(read(spark, sf_dir, "events"), {"low": F.col("value") >= 5, "kind": F.col("event_type") != "error"})
    return found.select("event_id", F.array_join("broken", "").alias("broken"))


@query("plain_rule", "SELECT 'orders' AS owner, count(*) AS checked, count(*) FILTER (WHERE NOT (o_totalprice <= 400000)) AS violations, CAST(0 AS BIGINT) AS unknown FROM orders")
def plain_rule(spark, sf_dir):
    tables, graph = tpc(spark, sf_dir, "orders"), tpc_graph("orders")
    text, _ = plain.to_rule("o totalprice must be at most 400000", tables["orders"].columns)
    return plans.report(plans.compile_rules([text], tables, graph), tables, graph).select("owner", "checked", "violations", "unknown")


@query("pattern_shares", "SELECT 'props' AS \"column\", p AS pattern, CASE WHEN p = 'json' THEN round(avg(CAST(regexp_matches(trim(props), '^\\{.*\\}$') AS DOUBLE)), 6) ELSE 0.0 END AS share FROM events, (SELECT unnest(['email', 'uuid', 'url', 'ipv4', 'money', 'phone', 'json']) AS p) GROUP BY 2")
def pattern_shares(spark, sf_dir):
    return semantics.shares(read(spark, sf_dir, "events"), ["props"]).withColumn("share", F.round("share", 6))


@query("date_formats", "SELECT * FROM (VALUES ('slashes', 'dd/MM/yyyy'), ('digits', 'none'), ('words', 'dd MMM yyyy')) AS t(\"column\", format)")
def date_formats(spark, sf_dir):
    d = F.col("o_orderdate")
    o = read(spark, sf_dir, "orders").select(F.date_format(d, "dd/MM/yyyy").alias("slashes"), F.date_format(d, "yyyyMMdd").alias("digits"), F.date_format(d, "dd MMM yyyy").alias("words"))
    return spark.createDataFrame([(c, semantics.date_format(o, c) or "none") for c in o.columns], "column string, format string")


@query("semantic_types")
def semantic_types(spark, sf_dir):
    found = semantics.propose(read(spark, sf_dir, "customer"), "customer")
    return spark.createDataFrame([(c["name"], c["family"], c["semantic"], len(c["constraints"])) for c in found["columns"]], "name string, family string, semantic string, constraints int")


@example("request_dataset", "SELECT CAST(2000 AS BIGINT) AS customers, CAST(60 AS BIGINT) AS flagged, CAST(8000 AS BIGINT) AS history")
def request_dataset(spark, sf_dir):
    t = requests.build(spark, requests.parse("2k bank customers in Spain with 3% fraud and 4 months of history", seed=1).config)
    c = t["customers"].agg(F.count(F.lit(1)).alias("customers"), F.count_if("is_fraud").alias("flagged"))
    return c.crossJoin(t["monthly_activity"].agg(F.count(F.lit(1)).alias("history")))


@example("request_edits", "SELECT CAST(1000 AS BIGINT) AS customers, CAST(50 AS BIGINT) AS flagged, CAST(3000 AS BIGINT) AS history")
def request_edits(spark, sf_dir):
    base = requests.parse("2000 bank customers", seed=1).config
    ops, _ = requests.interpret("halve the rows; fraud to 5%; keep 3 months", base)
    t, _ = requests.replay(spark, base, ops)
    c = t["customers"].agg(F.count(F.lit(1)).alias("customers"), F.count_if("is_fraud").alias("flagged"))
    return c.crossJoin(t["monthly_activity"].agg(F.count(F.lit(1)).alias("history")))


@example("shop_integrity", "SELECT CAST(0 AS BIGINT) AS faults")
def shop_integrity(spark, sf_dir):
    found = integrity.report(datasets.shop(spark, 300, 1, True), datasets.shop_graph(True))
    return found.agg(F.sum("count").alias("faults"))


@example("shop_enforced", "SELECT CAST(0 AS BIGINT) AS violations")
def shop_enforced(spark, sf_dir):
    checkpoints(spark)
    t, g = datasets.shop(spark, 200, 3, True), datasets.shop_graph(True)
    broken = t | {"orders": t["orders"].withColumn("total", F.col("total") + 1).withColumn("discount", F.col("discount") + 0.25)}
    fixed, report = repair.enforce(broken, g, datasets.SHOP_RULES, {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "item_id", "shipments": "shipment_id"}, seed=1)
    return spark.createDataFrame([(sum(report.after.values()),)], "violations long")


def _dataset(name: str):
    def fn(spark, sf_dir):
        tables = datasets.source(spark, name, 200, 1)
        out = None
        for t, df in tables.items():
            part = df.agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows"))
            out = part if out is None else out.unionByName(part)
        return out

    return fn


for _name in datasets.PACKS:
    example(f"dataset_{_name}")(_dataset(_name))


@query("export_schema", "SELECT 'c_mktsegment' AS name, 'str' AS kind, max(length(c_mktsegment)) AS max_len FROM customer UNION ALL SELECT 'c_name', 'str', max(length(c_name)) FROM customer")
def export_schema(spark, sf_dir):
    found = sinks.schema_of({"customer": read(spark, sf_dir, "customer")})["customer"]
    return spark.createDataFrame([(c.name, c.kind, c.max_len) for c in found.columns if c.kind == "str"], "name string, kind string, max_len long")


@query("sql_literals", "SELECT c_custkey, '''' || replace(c_name || chr(39), '''', '''''') || '''' AS name, CASE WHEN c_nationkey = 3 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer")
def sql_literals(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("'")).alias("n"), F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return df.select("c_custkey", sinks.literal(F.col("n"), "str", "ansi").alias("name"), sinks.literal(F.col("k"), "int", "ansi").alias("nation"))


@example("suites_met", "SELECT * FROM (VALUES ('customers', CAST(5 AS BIGINT), CAST(5 AS BIGINT)), ('healthcare', 12, 12), ('shop_full', 21, 21)) AS t(suite, expectations, met)")
def suites_met(spark, sf_dir):
    rows = []
    for name in sorted(suites.SUITES):
        found = suites.validate(name, datasets.source(spark, name, 200, 3))
        rows.append((name, len(found), sum(r["success"] for r in found)))
    return spark.createDataFrame(rows, "suite string, expectations long, met long")


# a request for as many customers as a customer's number says, in one of four languages
_REQUESTS = "CASE c_custkey % 4 WHEN 0 THEN '生成' || c_custkey || '万个银行客户，' || (c_custkey % 9 + 1) || '％欺诈' WHEN 1 THEN {hi} || ' हज़ार बैंक ग्राहक बनाओ' WHEN 2 THEN {ur} || ' لاکھ بینک صارفین بنائیں' ELSE 'أنشئ ' || {ar} || ' عملاء بنك مع احتيال' END"
_DIGITS = {"hi": "०१२३४५६७८९", "ur": "۰۱۲۳۴۵۶۷۸۹", "ar": "٠١٢٣٤٥٦٧٨٩"}


@query("requests_in_english", """
SELECT c_custkey, ['zh', 'hi', 'ur', 'ar'][c_custkey % 4 + 1] AS language,
       CASE c_custkey % 4 WHEN 0 THEN 'generate ' || c_custkey || '0000 bank customers, ' || (c_custkey % 9 + 1) || '% fraud' WHEN 1 THEN c_custkey || '000 bank customers generate'
       WHEN 2 THEN c_custkey || '00000 bank customers generate' ELSE 'generate ' || c_custkey || ' customers bank with fraud' END AS english
FROM customer
""")
def requests_in_english(spark, sf_dir):
    digits = {k: f"translate(cast(c_custkey as string), '0123456789', '{v}')" for k, v in _DIGITS.items()}
    texts = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_REQUESTS.format(**digits)).alias("text"))
    return texts.select("c_custkey", multilingual.language(F.col("text")).alias("language"), multilingual.english(F.col("text")).alias("english"))
