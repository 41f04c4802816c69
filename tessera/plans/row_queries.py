"""Row operators, repairs, generation and check digits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import checksums, hashing
from tessera.functions.normal import phi_inverse
from tessera.operators import claims, generate, relational, repair, rows
from tessera.operators.rules import plans
from tessera.schema import Graph
from tessera.sources.tables import read, tpc, tpc_graph

from .registry import example, query

U = hashing.uniform_sql


@query("duplicate_rows_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r > 1")
def duplicate_rows_first(spark, sf_dir):
    found = rows.repeats(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return found.where("repeated").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("duplicate_rows_none", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def duplicate_rows_none(spark, sf_dir):
    return rows.repeats(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [], "none").where("repeated").select("l_orderkey", "l_linenumber", "l_partkey")


@query("line_numbers", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS line FROM orders")
def line_numbers(spark, sf_dir):
    return rows.numbered(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey", "line")


@query("running_balance", "SELECT event_id, user_id, round(100 + sum(CASE WHEN event_type = 'purchase' THEN -value ELSE value END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS balance FROM events")
def running_balance(spark, sf_dir):
    amount = F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value"))
    return rows.running_balance(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], amount, 100.0).select("event_id", "user_id", F.round("balance", 6).alias("balance"))


@query("balance_gaps", """
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS balance FROM events)
SELECT event_id, user_id, seq FROM (SELECT *, lag(balance) OVER w AS pb, lag(seq) OVER w AS ps FROM e WHERE event_id % 7 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE seq - ps = 1 AND abs(pb + value - balance) > 0.5
""")
def balance_gaps(spark, sf_dir):
    e = rows.running_balance(rows.numbered(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "seq"), "user_id", ["ts", "event_id"], F.col("value"))
    e = e.withColumn("balance", F.round("balance", 2) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).where("event_id % 7 <> 0")
    return rows.balance_gaps(e, "user_id", "seq", F.col("value"), "balance", 0.5).select("event_id", "user_id", F.col("seq").cast("long").alias("seq"))


@query("opening_closing", "SELECT user_id, arg_min(value, event_id) AS opening, arg_max(value, event_id) AS closing FROM events GROUP BY 1")
def opening_closing(spark, sf_dir):
    return rows.first_last(read(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("topk_exact_rate", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= CAST(floor(0.05 * count(*) OVER () + 0.5) AS BIGINT) AS flag FROM customer) SELECT c_custkey, flag FROM r
""")
def topk_exact_rate(spark, sf_dir):
    return rows.flag_top(read(spark, sf_dir, "customer"), F.col("c_acctbal"), 0.05, "c_custkey").select("c_custkey", "flag")


@query("exact_copies", """
WITH k AS (SELECT md5(text) AS k, doc_id FROM documents), a AS (SELECT k, count(*) AS n FROM k WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT k, count(*) AS m FROM k WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT CAST((SELECT coalesce(sum(m), 0) FROM b JOIN a USING (k) WHERE n = 1) AS BIGINT) AS copies, CAST((SELECT coalesce(sum(n), 0) FROM a WHERE n > 1) AS BIGINT) AS repeated, CAST((SELECT sum(n) FROM a) AS BIGINT) AS rows
""")
def exact_copies(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return rows.exact_copies(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["text"])


@query("segment_scale_drop", "SELECT 'customer' AS \"table\", count(*) AS rows FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def segment_scale_drop(spark, sf_dir):
    t = tpc(spark, sf_dir, "customer", "orders")
    left = rows.drop_with_children(t, "customer", t["customer"].where("c_mktsegment = 'BUILDING'"), "c_custkey", {"orders": "o_custkey"})
    counts = [left[n].agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n in ("customer", "orders")]
    return counts[0].unionByName(counts[1])


@query("changed_columns", "SELECT 'c_acctbal' AS \"column\", count(*) FILTER (WHERE c_acctbal < 0) AS changed FROM customer UNION ALL SELECT 'c_name', 0 UNION ALL SELECT 'c_nationkey', 0 UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE c_mktsegment <> lower(c_mktsegment)) FROM customer")
def changed_columns(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    after = c.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0))).withColumn("c_mktsegment", F.lower("c_mktsegment"))
    return rows.changed(c, after, "c_custkey")


@example("entity_pairs", """
WITH r AS (SELECT p_partkey AS record, p_size AS entity, lower(trim(p_brand || p_type)) AS name FROM part)
SELECT a.record AS a, b.record AS b, CASE WHEN a.entity = b.entity THEN 1 ELSE 0 END AS label FROM r a JOIN r b ON a.record < b.record AND ((a.entity = b.entity AND a.name IS NOT NULL) OR (a.name = b.name AND a.entity <> b.entity)) WHERE a.entity <= 3 AND b.entity <= 3
""")
def entity_pairs(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_size <= 3").withColumn("n", F.concat("p_brand", "p_type"))
    return rows.pairs_of_entities(part, "p_size", "p_partkey", "n")


@query("entity_pairs_all", """
WITH r AS (SELECT p_partkey AS record, concat_ws('/', p_brand, p_type, p_size) AS entity, lower(trim(p_name || p_brand || p_size)) AS name FROM part),
s AS (SELECT a.record AS a, b.record AS b, 1 AS label FROM r a JOIN r b ON a.entity = b.entity AND a.record < b.record),
n AS (SELECT a.record AS a, b.record AS b, 0 AS label FROM r a JOIN r b ON a.name = b.name AND a.record < b.record WHERE a.entity <> b.entity)
SELECT * FROM s UNION ALL SELECT * FROM n
""")
def entity_pairs_all(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("e", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))).withColumn("n", F.concat("p_name", "p_brand", F.col("p_size").cast("string")))
    return rows.pairs_of_entities(part, "e", "p_partkey", "n")


_USER_SQL = "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n, rank() OVER (ORDER BY n DESC, o_custkey) AS place FROM t WHERE n > 3 UNION ALL SELECT c_custkey, CAST(-1 AS BIGINT), 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


@query("user_sql_guarded", _USER_SQL.replace("rank() OVER (ORDER BY n DESC, o_custkey)", "CAST(rank() OVER (ORDER BY n DESC, o_custkey) AS INTEGER)"))
def user_sql_guarded(spark, sf_dir):
    for n in ("orders", "customer"):
        read(spark, sf_dir, n).createOrReplaceTempView(n)
    return rows.select_only(spark, _USER_SQL)


@query("auto_join_1hop", "SELECT c_mktsegment AS grp, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def auto_join_1hop(spark, sf_dir):
    j = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 6).alias("mean"))


@query("auto_join_2hop", "SELECT c_mktsegment AS grp, count(*) AS n_rows, round(sum(l_quantity), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def auto_join_2hop(spark, sf_dir):
    per_order = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    j = per_order.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("grp")).agg(F.sum("n").alias("n_rows"), F.round(F.sum("q"), 2).alias("total"))


@query("json_props_profile", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, round(avg(CAST(regexp_matches(props, '^\\{.*\\}$') AS INTEGER)), 6) AS json_share FROM events GROUP BY 1")
def json_props_profile(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.round(F.avg(F.col("props").rlike(r"^\{.*\}$").cast("int")), 6).alias("json_share"))


# hashing, sampling and injection


@query("md5_uniform", f"SELECT o_orderkey, {U(7, 'demo', 'o_orderkey')} AS u FROM orders")
def md5_uniform(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", hashing.uniform(7, "demo", F.col("o_orderkey")).alias("u"))


@query("md5_gaussian", f"SELECT o_orderkey, round(sqrt(-2 * ln(greatest({U(7, 'g/a', 'o_orderkey')}, 2.0 ** -52))) * cos(2 * pi() * {U(7, 'g/b', 'o_orderkey')}), 9) AS z FROM orders")
def md5_gaussian(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(hashing.gaussian(7, "g", F.col("o_orderkey")), 9).alias("z"))


@query("exact_sample", f"SELECT o_orderkey FROM orders ORDER BY {U(3, 'sample', 'o_orderkey')}, o_orderkey LIMIT 137")
def exact_sample(spark, sf_dir):
    return rows.sampled(read(spark, sf_dir, "orders").select("o_orderkey"), 137, 3, "o_orderkey")


@query("null_injection_exact", f"SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY {U(5, 'null/c_acctbal', 'c_custkey')}, c_custkey) <= CAST(floor(0.1 * count(*) OVER () + 0.5) AS BIGINT) THEN -99999.0 ELSE c_acctbal END AS v FROM customer")
def null_injection_exact(spark, sf_dir):
    made = generate.nulls_injected(read(spark, sf_dir, "customer"), "c_acctbal", 0.1, 5, "c_custkey")
    return made.select("c_custkey", F.coalesce("c_acctbal", F.lit(-99999.0)).alias("v"))


@query("outlier_iqr", f"""
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer),
r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY {U(5, 'outlier/c_acctbal', 'c_custkey')}, c_custkey) <= CAST(floor(0.02 * count(*) OVER () + 0.5) AS BIGINT) AS hit, {U(5, 'size/c_acctbal', 'c_custkey')} AS u, {U(5, 'side/c_acctbal', 'c_custkey')} AS s FROM customer)
SELECT c_custkey, round(CASE WHEN NOT hit THEN c_acctbal WHEN s < 0.5 THEN q3 + (1.5 + 1.5 * u) * (q3 - q1) ELSE q1 - (1.5 + 1.5 * u) * (q3 - q1) END, 6) AS v FROM r, q
""")
def outlier_iqr(spark, sf_dir):
    made = generate.outliers_injected(read(spark, sf_dir, "customer"), "c_acctbal", 0.02, 5, "c_custkey")
    return made.select("c_custkey", F.round("c_acctbal", 6).alias("v"))


@query("copula_marginal_numeric", f"""
WITH g AS (SELECT quantile_cont(l_extendedprice, [x / 100 for x in range(0, 101)]) AS q FROM lineitem), u AS (SELECT o_orderkey, {U(9, 'marginal', 'o_orderkey')} * 100 AS a FROM orders)
SELECT o_orderkey, round(q[CAST(least(floor(a), 99) AS BIGINT) + 1] + (a - least(floor(a), 99)) * (q[CAST(least(floor(a), 99) AS BIGINT) + 2] - q[CAST(least(floor(a), 99) AS BIGINT) + 1]), 6) AS v FROM u, g
""")
def copula_marginal_numeric(spark, sf_dir):
    p = generate.profile(read(spark, sf_dir, "lineitem"), ["l_extendedprice"])[0]
    u = hashing.uniform(9, "marginal", F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(generate.marginal(p, u, F.col("o_orderkey")), 6).alias("v"))


@query("copula_marginal_category", f"""
WITH f AS (SELECT c_mktsegment AS v, count(*) / sum(count(*)) OVER () AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1), c AS (SELECT v, r, sum(s) OVER (ORDER BY r) AS m FROM f), u AS (SELECT o_orderkey, {U(9, 'category', 'o_orderkey')} AS u FROM orders)
SELECT o_orderkey, arg_min(v, r) AS v FROM u JOIN c ON u < m OR r = (SELECT max(r) FROM c) GROUP BY 1
""")
def copula_marginal_category(spark, sf_dir):
    p = generate.profile(read(spark, sf_dir, "customer"), ["c_mktsegment"])[0]
    u = hashing.uniform(9, "category", F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", generate.marginal(p, u, F.col("o_orderkey")).alias("v"))


@example("normal_quantile", "SELECT i AS id, round(z, 2) AS z FROM (VALUES (1, -2.326348), (5, -1.644854), (25, -0.67449), (50, 0.0), (84, 0.994458), (99, 2.326348)) AS t(i, z)")
def normal_quantile(spark, sf_dir):
    df = spark.createDataFrame([(i,) for i in (1, 5, 25, 50, 84, 99)], "id int")
    return df.select("id", F.round(phi_inverse(F.col("id") / 100.0), 2).alias("z"))


# without an SQL form: fitted models and whole generators
@query("copula_sample")
def copula_sample(spark, sf_dir):
    model = generate.fit(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"])
    return generate.sample(spark, model, 5_000, seed=1).drop("__id")


@query("copula_conditional")
def copula_conditional(spark, sf_dir):
    model = generate.fit(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    given = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 10).alias("l_extendedprice"))
    return generate.sample_given(model, given, "o_orderkey", ["l_extendedprice"], seed=2)


@query("relational_generation")
def relational_generation(spark, sf_dir):
    tables, graph = tpc(spark, sf_dir, "customer", "orders"), tpc_graph("customer", "orders")
    return relational.generate_all(relational.fit(tables, graph), seed=3).tables["orders"]


@query("child_counts_poisson", "SELECT c_custkey, 0 AS bad FROM customer")
def child_counts_poisson(spark, sf_dir):
    made = generate.child_counts(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "poisson", 4, "orders", lam=3.0)
    return made.select("c_custkey", F.when(F.col("children").between(0, 60), 0).otherwise(1).alias("bad"))


@query("fit_to_total", "SELECT CAST(20000 AS BIGINT) AS total, count(*) AS parents FROM customer")
def fit_to_total(spark, sf_dir):
    made = generate.child_counts(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "fixed", 4, "orders", value=20)
    fixed = generate.fit_to_total(made, "c_custkey", 20_000, 4)
    return fixed.agg(F.sum("children").alias("total"), F.count(F.lit(1)).alias("parents"))


@query("self_reference_forest", "SELECT CAST(0 AS BIGINT) AS cycles, count(*) AS rows FROM customer")
def self_reference_forest(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", generate.self_reference(F.col("c_custkey"), 6).alias("parent"))
    return df.agg(F.count_if(F.col("parent") >= F.col("c_custkey")).alias("cycles"), F.count(F.lit(1)).alias("rows"))


# repairs


@query("derive_repair", "SELECT o_orderkey, round_even(coalesce(s, 0), 2) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def derive_repair(spark, sf_dir):
    tables, graph = tpc(spark, sf_dir, "orders", "lineitem"), tpc_graph("orders", "lineitem")
    rule = plans.compile_rules(["o_totalprice = SUM(lineitem.l_extendedprice)"], tables, graph)[0]
    frames = plans.Frames(tables, graph)
    df, made = frames.owner_frame([rule])
    value = plans.expression(rule.tree.args[1], frames.types, made)
    return df.select(F.col("`orders.o_orderkey`").alias("o_orderkey"), repair.derived(F.col("`orders.o_totalprice`"), value, 2).alias("o_totalprice"))


@query("bound_reflect", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount <= 0.05 THEN l_discount ELSE least(0.1 - l_discount, 0.05) END, 9) AS l_discount FROM lineitem")
def bound_reflect(spark, sf_dir):
    made = repair.reflected(F.col("l_discount"), F.lit(0.05), "<=", 0.01)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(made, 9).alias("l_discount"))


@query("unique_renumber", """
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_custkey FROM r WHERE k = 1 UNION ALL SELECT o_orderkey, (SELECT max(o_custkey) FROM orders) + row_number() OVER (ORDER BY o_custkey, k, o_orderkey) FROM r WHERE k > 1
""")
def unique_renumber(spark, sf_dir):
    return repair.renumbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"])


@query("decimal_places", "SELECT 'l_discount' AS \"column\", 2 AS places UNION ALL SELECT 'l_quantity', 0")
def decimal_places(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(c, repair.decimals(lines, c)) for c in ("l_discount", "l_quantity")], "column string, places int")


# edge cases


@query("edge_leap", f"""
WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY {U(8, 'edge/leap_year_dates/o_orderdate', 'o_orderkey')}, o_orderkey) - 1 AS t, CAST(floor(0.02 * count(*) OVER () + 0.5) AS BIGINT) AS k FROM orders)
SELECT o_orderkey, CASE WHEN t >= k THEN o_orderdate ELSE CAST(['2024-02-29', '2024-02-28', '2024-03-01', '2000-02-29'][CAST(t % 4 AS BIGINT) + 1] AS TIMESTAMP) + (o_orderdate - date_trunc('day', o_orderdate)) END AS o_orderdate,
  CASE WHEN t >= k THEN '-' ELSE 'leap_year_dates:' || ['leap_day', 'before', 'after', 'century'][CAST(t % 4 AS BIGINT) + 1] END AS tag FROM r
""")
def edge_leap(spark, sf_dir):
    made = generate.edge_cases(read(spark, sf_dir, "orders"), "o_orderdate", "leap_year_dates", 0.02, 8, "o_orderkey")
    return made.select("o_orderkey", "o_orderdate", F.coalesce("_edge_case", F.lit("-")).alias("tag"))


def _edge(table: str, column: str, pack: str, key: str):
    def fn(spark, sf_dir):
        made = generate.edge_cases(read(spark, sf_dir, table), column, pack, 0.05, 8, key)
        return made.where("_edge_case is not null").groupBy("_edge_case").agg(F.count(F.lit(1)).alias("n"))

    return fn


for _table, _column, _pack, _key, _cases in (
    ("customer", "c_acctbal", "boundary_values", "c_custkey", ("zero", "minus_one", "max", "min", "tiny")),
    ("part", "p_name", "typos", "p_partkey", ("swap", "drop", "double", "case", "neighbour", "space")),
    ("customer", "c_acctbal", "negative_balances", "c_custkey", ("negated", "small")),
    ("orders", "o_orderdate", "timezone_shifts", "o_orderkey", ("plus", "minus", "gap", "overlap", "last_second")),
):
    _names = ", ".join(f"'{c}'" for c in _cases)
    query(f"edge_{_pack}", f"SELECT '{_pack}:' || [{_names}][CAST(t AS BIGINT) + 1] AS _edge_case, count(*) AS n FROM (SELECT unnest(range(0, CAST(floor(0.05 * count(*) + 0.5) AS BIGINT))) % {len(_cases)} AS t FROM {_table}) GROUP BY 1")(_edge(_table, _column, _pack, _key))


@query("edge_duplicates", "SELECT count(*) + CAST(floor(0.05 * count(*) + 0.5) AS BIGINT) AS rows, CAST(floor(0.05 * count(*) + 0.5) AS BIGINT) AS tagged FROM part")
def edge_duplicates(spark, sf_dir):
    made = generate.duplicates_added(read(spark, sf_dir, "part"), "p_name", 0.05, 8, "p_partkey")
    return made.agg(F.count(F.lit(1)).alias("rows"), F.count("_edge_case").alias("tagged"))


# check digits


@query("check_digits", """
WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 8, '0') AS body FROM customer),
l AS (SELECT c_custkey, body, CAST((10 - list_sum([CASE WHEN i % 2 = 1 THEN (CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END) ELSE d END for d, i in [CAST(x AS INTEGER) for x in string_split(reverse(body), '')]]) % 10) % 10 AS VARCHAR) AS luhn FROM n)
SELECT c_custkey, body, luhn, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(body AS BIGINT) % 23 + 1, 1) AS dni, lpad(CAST(97 - CAST(body AS BIGINT) % 97 AS VARCHAR), 2, '0') AS insee FROM l
""")
def check_digits(spark, sf_dir):
    body = F.lpad((F.col("c_custkey") * 7919).cast("string"), 8, "0")
    df = read(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))
    return df.select("c_custkey", "body", checksums.luhn_digit(F.col("body")).alias("luhn"), checksums.dni_letter(F.col("body")).alias("dni"), checksums.insee_key(F.col("body")).alias("insee"))


@query("check_round_trip", "SELECT a AS algorithm, count(*) AS n, count(*) AS valid FROM customer, (SELECT unnest(['luhn', 'verhoeff', 'insee', 'iso7064']) AS a) GROUP BY 1")
def check_round_trip(spark, sf_dir):
    lengths = {"luhn": 8, "verhoeff": 11, "insee": 13, "iso7064": 17}
    out = None
    for a, n in lengths.items():
        body = F.lpad((F.col("c_custkey") * 7919).cast("string"), n, "1")
        full = F.concat(body, checksums.COMPUTE[a](body))
        part = read(spark, sf_dir, "customer").agg(F.lit(a).alias("algorithm"), F.count(F.lit(1)).alias("n"), F.count_if(checksums.valid(a, full)).alias("valid"))
        out = part if out is None else out.unionByName(part)
    return out


@query("claims_held", """
SELECT 0 AS claim, count(*) FILTER (WHERE n IS NOT NULL) = count(*) AS accepted, round(count(*) FILTER (WHERE n IS NOT NULL) / count(*), 6) AS share FROM (SELECT c_custkey AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
UNION ALL SELECT 1, bool_and(o_totalprice <= 300000), round(avg(CAST(o_totalprice <= 300000 AS DOUBLE)), 6) FROM orders
UNION ALL SELECT 2, bool_and(regexp_matches(c_name, '^-?[0-9.]+$')), round(avg(CAST(regexp_matches(c_name, '^-?[0-9.]+$') AS DOUBLE)), 6) FROM customer
""")
def claims_held(spark, sf_dir):
    wanted = [
        {"kind": "reference", "child": "orders", "columns": ["o_custkey"], "parent": "customer", "parent_columns": ["c_custkey"]},
        {"kind": "constraint", "table": "orders", "type": "range", "column": "o_totalprice", "max": 300_000},
        {"kind": "type", "table": "customer", "column": "c_name", "type": "number"},
    ]
    _, verdicts = claims.held({t: read(spark, sf_dir, t) for t in ("orders", "customer")}, Graph(), wanted)
    return spark.createDataFrame([(i, v["accepted"], round(v["share"], 6)) for i, v in enumerate(verdicts)], "claim int, accepted boolean, share double")
