"""Statistics, generation, locales, documents, sinks, jobs and the registry."""

import json
import math
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import jobs
from tessera.functions import checksums, formats, hashing
from tessera.functions.normal import phi, phi_inverse
from tessera.language import requests
from tessera.operators import claims, documents, generate, inference, neighbours, people, relational, rows, sampling, scoring, stats
from tessera.plans import row_queries
from tessera.schema import ForeignKey, Graph, Table
from tessera.sources import datasets, sinks
from tessera.sources.locales import PACKS, parse_mix


def test_uniforms_do_not_depend_on_partitions(spark):
    made = [sorted(r[0] for r in spark.range(500, numPartitions=n).select(hashing.uniform(1, "a", F.col("id"))).collect()) for n in (1, 7)]
    assert made[0] == made[1] and 0 <= min(made[0]) and max(made[0]) < 1 and abs(sum(made[0]) / 500 - 0.5) < 0.05


def test_normal_functions(spark):
    rows = spark.createDataFrame([(x,) for x in (-2.5, -1.0, 0.0, 0.3, 1.7)], "z double").select("z", phi(F.col("z")).alias("p"), phi_inverse(phi(F.col("z"))).alias("back")).collect()
    for r in rows:
        assert abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-6 and abs(r.back - r.z) < 1e-4


def test_identical_samples_score_full(spark):
    df = spark.range(400).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    assert stats.ks(df, df, "x").first().statistic == 0 and stats.tvd(df, df, "c").first().tvd == 0
    assert all(v["score"] == 100 for v in scoring.column_scores(df, df).values())
    assert abs(stats.spearman(df.withColumn("y", -F.col("x")), "x", "y").first().rho + 1) < 1e-12


def test_p_values():
    assert abs(stats.chi_square_p(3.841, 1) - 0.05) < 1e-3 and abs(stats.chi_square_p(18.307, 10) - 0.05) < 1e-3
    assert stats.ks_p(0.0, 100, 100) == 1.0 and stats.ks_p(0.5, 200, 200) < 1e-6


def test_running_sums_over_ranges(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("v"), F.lit(2).alias("n"))
    rows = stats.cumulative(df, "v", {"c": "n"}, buckets=7).collect()
    assert all(r.c == 2 * r.v for r in rows) and len(rows) == 1000


def test_nearest_of_any_number_of_queries(spark):
    """More queries than one task holds, each with a known nearest row."""
    vector = F.array(F.col("id").cast("double"), F.lit(3.0))
    queries = spark.range(60_000).select("id", vector.alias("v"))
    rows = spark.range(0, 60_000, 1_000).select("id", vector.alias("v"))
    found = neighbours.nearest(queries, rows, "id", "v").collect()
    assert len(found) == 60_000
    for r in found:
        low, over = r.id // 1_000 * 1_000, r.id % 1_000
        steps = [over] * (over > 0) + [1_000 - over] * (low < 59_000) + [1_000] * (over == 0 and low > 0)
        assert r.distance == min(steps)


def test_nearest_in_blocks(spark):
    r = random.Random(3)
    points = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(300)] + [(300, [1e3] * 5), (301, [1e3] * 5)]
    df = spark.createDataFrame([*points, (302, None), (None, [0.0] * 5), (303, [0.0, None, 0.0, 0.0, 0.0])], "k long, v array<double>")
    found = {x.id: x.distance for x in neighbours.nearest(df, df, "k", "v", block=40).collect()}
    assert found.keys() == {i for i, _ in points} and found[300] == found[301] == 0
    for i, v in points:
        assert abs(found[i] - min(math.dist(v, w) for j, w in points if j != i)) < 1e-9
    assert neighbours.nearest(df.limit(0), df, "k", "v").count() == 0 and neighbours.nearest(df, df.limit(0), "k", "v").count() == 0


def test_privacy_sees_every_row(spark):
    """Three copies among 6,000 synthetic rows, and a level beyond those that are encoded."""
    row = lambda shift: [F.col("id").alias("__id"), (F.col("id") * 1.7 + shift).alias("x"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("c")]
    train, holdout = spark.range(200).select(*row(0.0)), spark.range(200).select(*row(0.9))
    synthetic = spark.range(6_000).select(*row(0.3)).where("__id not in (7, 70, 170)").unionByName(train.where("__id in (7, 70, 170)"))
    near = synthetic.unionByName(train.limit(1).selectExpr("cast(9999 as long) as __id", "x", "'other' as c"))
    found = scoring.privacy(train, synthetic, holdout)
    assert found["copies"]["any"] == 3 / 6_000 and abs(found["parts"]["copies"] - 100 * (1 - 20 * 3 / 6_000)) < 1e-9
    assert {(a, b) for a, b, d in found["flagged"] if d == 0} == {(7, 7), (70, 70), (170, 170)}
    assert scoring.copied(train.drop("__id"), near.drop("__id"))["any"] == 3 / 6_001


def test_entity_pairs_of_the_whole_table(spark, tmp_path):
    """Every entity has its pairs, and every name its pairs across entities."""
    r = random.Random(5)
    part = [(i, r.choice("xy"), r.choice("AB"), r.choice("pq"), r.randrange(1, 51)) for i in range(400)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for a, na, ba, ta, sa in part:
        for b, nb, bb, tb, sb in part:
            if a < b and (ba, sa) == (bb, sb) and (ta == tb or na == nb):
                want.add((a, b, int(ta == tb)))
    found = [tuple(x) for x in row_queries.entity_pairs_all(spark, str(tmp_path)).collect()]
    assert len(found) == len(want) and set(found) == want


def test_copula_keeps_marginals_and_dependence(spark):
    real = datasets.customers(spark, 1500, 2)["customers"].select("age", "income", "plan")
    model = generate.fit(real)
    made = generate.sample(spark, model, 1500, seed=4).drop("__id")
    scores = scoring.column_scores(real, made)
    assert all(v["score"] > 90 for v in scores.values())
    a, b = (stats.spearman(d, "age", "income").first().rho for d in (real, made))
    assert abs(a - b) < 0.12
    again = generate.sample(spark, model, 1500, seed=4).drop("__id").repartition(3)
    assert made.exceptAll(again).count() == 0


def test_relational_generation_has_whole_keys(spark):
    t, g = datasets.shop(spark, 120, 1), datasets.shop_graph()
    made = relational.generate_all(relational.fit(t, g), seed=2).tables
    from tessera.operators import integrity

    assert integrity.report(made, g).agg(F.sum("count")).first()[0] == 0
    assert abs(made["orders"].count() - t["orders"].count()) < 0.35 * t["orders"].count()


def test_inferred_graph_of_the_shop(spark):
    graph = inference.infer(datasets.shop(spark, 150, 1))
    assert {(k.child, k.parent) for k in graph.keys} == {("orders", "customers"), ("order_items", "orders"), ("order_items", "products")}


def test_self_references_and_pairs(spark):
    e = spark.createDataFrame([(i, (i // 2) or None, i % 3) for i in range(1, 30)], "employee_id int, manager_id int, dept int")
    keys = inference.infer({"employees": e}).keys
    assert [(k.columns, k.parent) for k in keys] == [(("manager_id",), "employees")]


DDL = """
CREATE TABLE customers (id SERIAL PRIMARY KEY, "full name" VARCHAR(40) NOT NULL, joined DATE);
create table "orders" (order_id int, customer_id int references customers(id), total numeric(10,2), ok boolean, PRIMARY KEY (order_id)); -- a comment
CREATE TABLE items (order_id INT, line INT, PRIMARY KEY (order_id, line));
ALTER TABLE items ADD CONSTRAINT fk FOREIGN KEY (order_id) REFERENCES orders (order_id);
"""


def test_keys_of_any_pair_or_triple(spark):
    """The only key is the last of 28 pairs; in another table it takes three columns."""
    rows = [(*[i % 3] * 6, i % 8, i // 8) for i in range(64)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i}_id int" for i in range(8)))
    stats_of = {r["column"]: r.asDict() for r in inference.key_stats({"t": df}).collect()}
    assert inference.primary_key("t", df, stats_of) == ("c6_id", "c7_id")
    three = spark.createDataFrame([(i, j, k, i % 2) for i in range(4) for j in range(5) for k in range(6)], "a_id int, b_id int, c_id int, d_id int")
    stats_of = {r["column"]: r.asDict() for r in inference.key_stats({"t": three}).collect()}
    assert inference.primary_key("t", three, stats_of) == ("a_id", "b_id", "c_id")
    assert inference.unique_sets(three, {"a_id": 4, "b_id": 5, "c_id": 6, "d_id": 2}) == [("a_id", "b_id", "c_id")]
    assert inference.unique_sets(three.limit(0), {}) == []


def test_ddl():
    g = inference.parse_ddl(DDL)
    assert g.order() == ["customers", "orders", "items"] and g.tables["items"].key == ("order_id", "line")
    assert g.tables["orders"].columns == {"order_id": "int", "customer_id": "int", "total": "float", "ok": "bool"}
    assert [k.name for k in g.keys] == ["orders(customer_id)->customers(id)", "items(order_id)->orders(order_id)"]
    with pytest.raises(ValueError):
        inference.parse_ddl("create table a (x int references nowhere(y))")


def test_graph_rules():
    g = Graph([Table("a", {"id": "int"}, ("id",)), Table("b", {"id": "int", "a_id": "int"}, ("id",))])
    g.add(ForeignKey("b", ("a_id",), "a", ("id",)))
    with pytest.raises(ValueError):
        g.add(ForeignKey("a", ("id",), "b", ("id",)))
    assert Graph.from_json(g.to_json()).keys == g.keys and g.ancestors("b") == ["a"] and g.path("a", "b") is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_are_linear(spark, values):
    import numpy as np

    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert np.allclose(stats.quantiles(df, "v", 5), np.quantile(values, [0, 0.25, 0.5, 0.75, 1]))


def test_kth_smallest_narrows_to_the_value(spark):
    r = random.Random(4)
    values = [r.choice([1.0, 2.0, r.gauss(0, 1)]) for _ in range(3_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranked = sorted(values)
    for k in (1, 700, 1_500, 2_999, 3_000):
        value, below = stats.kth_smallest(df, "v", k, few=50)
        assert value == ranked[k - 1] and below == sum(v < value for v in values)
    with pytest.raises(ValueError):
        stats.kth_smallest(df, "v", 3_001)


def test_exactly_is_the_smallest_hashes(spark):
    df = spark.range(5_000)
    hashes = {x.id: x.u for x in df.select("id", hashing.uniform(2, "s", F.col("id")).alias("u")).collect()}
    want = sorted(hashes, key=hashes.get)
    for k in (0, 1, 777, 5_000, 9_000):
        found = {x.id for x in hashing.exactly(df, k, 2, "s", "id", few=3).collect()}
        assert found == set(want[:k])


def test_flags_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 2)) for i in range(30)], "id long, s double")
    for rate in (0.2, 0.5, 0.8, 1.0):
        flagged = {x.id for x in rows.flag_top(df, F.col("s"), rate, "id").where("flag").collect()}
        order = sorted(range(30), key=lambda i: (i % 3 == 0, -(i % 2) if i % 3 else 0, i))
        assert flagged == set(order[: int(rate * 30 + 0.5)])


def test_rare_categories_are_kept(spark, monkeypatch):
    """More values than are held on the driver: all of them are drawn, by their shares."""
    monkeypatch.setattr(generate, "FEW", 20)
    df = spark.range(4_000).select(F.when(F.col("id") < 2_000, "often").otherwise(F.concat(F.lit("v"), (F.col("id") % 40).cast("string"))).alias("c"), (F.col("id") % 97).cast("double").alias("x"))
    model = generate.fit(df)
    assert model.profiles[0].table is not None
    counts = {r.c: r["count"] for r in generate.sample(spark, model, 8_000, 3).groupBy("c").count().collect()}
    assert len(counts) == 41 and sum(counts.values()) == 8_000 and abs(counts["often"] - 4_000) < 300
    given = generate.sample_given(model, spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("x")), "k", ["x"])
    assert given.where("c is null").count() == 0 and given.count() == 500


def test_every_parent_is_within_reach(spark):
    """Also where the number of parents is a multiple of the usual factor."""
    keys = spark.range(60_000).select(generate.other_reference(None, "id", 7_919, 1, "x").alias("k"))
    assert keys.distinct().count() > 7_000


def test_unreachable_samples_raise(spark):
    model = generate.from_spec([{"name": "x", "min": 0.0, "max": 1.0}])
    with pytest.raises(ValueError, match="of 50 rows"):
        sampling.with_rules(spark, model, 50, ["x > 2"], "reject", seed=1)


def test_rare_candidates_mend_what_frequent_ones_cannot(spark):
    """Ninety frequent values break the rule; one that a single row has, the ninety-fifth by frequency, keeps it for some rows."""
    rows = [(i, f"v{i % 90:02d}", 10) for i in range(900)] + [(1_000 + i, f"w{i}", 10) for i in range(9)] + [(2_000 + i, "v00", 50 + i) for i in range(4)] + [(3_000, None, 60)]
    df = spark.createDataFrame(rows, "k int, c string, x int")
    found = {r.k: r.c for r in sampling.candidate_search(df, "c", ["x < 50 or c = 'w4' or c is null", "x != 53 or c = 'none'"]).collect()}
    kept = {k: c for k, c, _ in rows if k not in range(2_000, 2_004)}
    assert found == kept | {2_000: "w4", 2_001: "w4", 2_002: "w4", 2_003: "v00"}
    numbers = spark.createDataFrame([(i, float(i % 7), 100.0) for i in range(60)] + [(100, 99.5, 100.0), (200, 3.0, 5.0), (201, 2.0, 99.0)], "k int, c double, x double")
    found = {r.k: r.c for r in sampling.candidate_search(numbers, "c", ["x = 100 or c > x"], first=2).collect()}
    assert found[201] == 99.5 and found[200] == 6.0 and found[100] == 99.5 and found[5] == 5.0


def test_random_negatives(spark):
    df = spark.range(3_000).select(F.col("id"), (F.col("id") % 1_000).alias("e"), F.concat(F.lit("n"), (F.col("id") % 1_000).cast("string")).alias("n"))
    found = rows.pairs_of_entities(df, "e", "id", "n", n_negative=500, seed=2).collect()
    none = [x for x in found if not x.label]
    assert len(none) == 500 and len(found) == 3_500 and all(x.a % 1_000 != x.b % 1_000 for x in none) and len({(x.a, x.b) for x in none}) == 500


def test_claims_are_held_against_the_data(spark):
    t = {"a": spark.createDataFrame([(1, "x@y.org", "03/02/2024"), (2, "u@v.com", "28/02/2024"), (3, None, None)], "id int, mail string, day string"), "b": spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "a_id int")}
    said = [
        {"kind": "type", "table": "a", "column": "mail", "type": "email"}, {"kind": "type", "table": "a", "column": "day", "type": "date", "format": "dd/MM/yyyy"},
        {"kind": "type", "table": "a", "column": "day", "type": "number"}, {"kind": "type", "table": "a", "column": "nothing", "type": "email"},
        {"kind": "reference", "child": "b", "columns": ["a_id"], "parent": "a", "parent_columns": ["id"]}, {"kind": "constraint", "table": "a", "type": "not_null", "column": "id"}, {"kind": "x"},
    ]
    graph, found = claims.held(t, Graph(), said)
    assert [v["accepted"] for v in found] == [True, True, False, False, False, True, False] and found[4]["share"] == 0.75 and not graph.keys
    graph, found = claims.held(t | {"b": t["b"].where("a_id < 9")}, Graph(), said)
    assert found[4]["accepted"] and [k.name for k in graph.keys] == ["b(a_id)->a(id)"]


def test_known_check_digits(spark):
    row = spark.range(1).select(checksums.valid("luhn", F.lit("4539 1488 0343 6467")).alias("a"), checksums.valid("luhn", F.lit("8273123273520569")).alias("b"), checksums.valid("verhoeff", F.lit("2363")).alias("c"), checksums.valid("verhoeff", F.lit("2364")).alias("d"), checksums.valid("dni", F.lit("12345678Z")).alias("e"), checksums.valid("iso7064", F.lit("11010519491231002X")).alias("f"), checksums.valid("iso7064", F.lit("110105194912310021")).alias("g")).first()
    assert tuple(row) == (True, False, True, False, True, True, False)


def test_money_in_locales(spark):
    v = F.lit(Decimal("1234567.50"))
    row = spark.range(1).select(*[formats.money(v, PACKS[l]).alias(l) for l in ("en-US", "es-ES", "hi-IN")]).first()
    assert tuple(row) == ("$1,234,567.50", "1.234.567,50 €", "₹12,34,567.50")
    assert parse_mix("en-US:2, fr") == {"en-US": 2 / 3, "fr-FR": 1 / 3}


def test_people_agree_with_their_locale(spark):
    rows = people.coherence(people.generate(spark, 200, parse_mix("hi,zh,es"), seed=1)).collect()
    assert all(r.failures == 0 for r in rows)


def test_statement_queries():
    q = documents.parse_statement_query
    assert q("debits over 5k in the last 3 months at Acme") == documents.StatementFilter(days=90, amount_min=Decimal("5000.01"), kind="debit", merchant="acme")
    assert q("balance below 100").balance_max == Decimal("99.99") and q("between 10 and 20").amount_max == Decimal(20)
    assert q("purple credits").unparsed == ["purple"]


def test_requests_and_edits():
    found = requests.parse("50k clientes de banco en España con 2% fraude y 12 meses")
    assert (found.config.rows, found.config.flag_rate, found.config.months, list(found.config.locales)) == (50_000, 0.02, 12, ["es-ES"])
    ops, questions = requests.interpret("double the vip segment; outliers 1%", found.config)
    assert ops == [{"op": "scale_segment", "segment": "vip", "factor": 2.0}] and len(questions) == 1
    said = {q.kind: q.value for q in requests.quantities("one thousand two hundred and fifty rows, 2.5 %, twenty two months, 3x")}
    assert said == {"count": 1_250, "share": 2.5, "period": 22, "times": 3}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "x\ny", 1.5)], "id int, s string, v double")
    done = sinks.merged(sinks.csv_lines(df), str(tmp_path / "a.csv"))
    import csv

    assert list(csv.reader(open(done.path, newline=""))) == [["id", "s", "v"], ["1", 'a,"b"', ""], ["2", "x\ny", "1.5"]]
    assert json.loads("".join(sinks.json_array(df))) == [{"id": 1, "s": 'a,"b"', "v": None}, {"id": 2, "s": "x\ny", "v": 1.5}]
    both = json.loads("".join(sinks.exporter("json")({"a": df, "empty": df.limit(0)}, None)))
    assert both["empty"] == [] and [r["id"] for r in both["a"]] == [1, 2]
    (tmp_path / "rows.csv").write_text("n,t\n" + "".join(f"{i},2024-01-0{1 + i % 9}\n" for i in range(500)))
    first = datasets.first_rows(spark, str(tmp_path / "rows.csv"), rows=100)
    assert first.count() == 100 and dict(first.dtypes)["t"] == "timestamp_ntz"
    gz = [sinks.merged(sinks.json_lines(df), str(tmp_path / f"{i}.gz"), compress=True).sha256 for i in range(2)]
    assert gz[0] == gz[1]


def test_sqlite_loads_dry_and_real(spark, tmp_path):
    import sqlite3

    t, g = datasets.shop(spark, 20, 1), datasets.shop_graph()
    path = str(tmp_path / "a.db")
    counts = sinks.load_sqlite(t, path, g, dry_run=True)
    con = sqlite3.connect(path)
    assert counts["customers"] == 20 and not con.execute("select name from sqlite_master").fetchall()
    sinks.load_sqlite(t, path, g)
    assert con.execute("select count(*) from orders").fetchone()[0] == counts["orders"]
    script = "".join(sinks.sql_dump(t, g, "sqlite"))
    fresh = sqlite3.connect(":memory:")
    fresh.executescript(script)
    assert fresh.execute("select count(*) from order_items").fetchone()[0] == counts["order_items"]


def test_targets_are_guarded():
    with pytest.raises(ValueError):
        sinks.target("postgresql://u:p@evil.example/db")
    with pytest.raises(ValueError):
        sinks.target("sqlite:////etc/passwd", folder="/tmp/data")
    assert sinks.masked("mysql://u:secret@localhost/db") == "mysql://u:***@localhost/db"


def test_jobs_reproduce(spark, tmp_path):
    store = jobs.Store(str(tmp_path))
    first = jobs.submit(spark, store, "dataset", {"name": "customers", "rows": 50, "seed": 3})
    again = jobs.rerun(spark, store, first["id"])
    assert first["state"] == "done" and again["reproduced"]
    assert jobs.submit(spark, store, "dataset", {"name": "nothing"})["state"] == "failed"
    with pytest.raises(ValueError):
        store.path(first["id"], "../../x")
    kept = jobs.saved(spark, store, "dataset", {"name": "customers", "rows": 5, "seed": 1}, lambda: {"rows": 5})
    assert kept["result"] == {"rows": 5} and jobs.rerun(spark, store, kept["id"])["state"] == "done"


def test_streams_agree_with_batches(spark, tmp_path):
    from tessera.streaming import events

    df = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:30:00", i % 7, "a", float(i)) for i in range(40)], "event_id int, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    batch = sorted(map(tuple, events.tumbling(df).collect()))
    found = events.drained(events.tumbling(events.stream(spark, str(tmp_path / "in"), df)), "tumbled", str(tmp_path / "cp"))
    assert sorted(map(tuple, found.collect())) == batch


def test_registry_and_entry(spark):
    import __spark_entry__ as e

    names, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 100
    assert e.entry(spark).count() == 6


def test_sets_that_repeat_in_a_part_are_not_counted_over_all_rows(spark, monkeypatch):
    """One repeat in any part keeps a set from being unique; sets that repeat in many are known from one part."""
    rows = [(i // 2, i % 2, i % 1_000) for i in range(4_000)]
    make = lambda r: spark.createDataFrame(r, "a_id int, b_id int, c_id int")
    distinct = {"a_id": 2_000, "b_id": 2, "c_id": 1_000}
    assert inference.unique_sets(make(rows), distinct) == [("a_id", "b_id"), ("a_id", "c_id")]
    for at in range(0, 40, 5):  # a repeat of one pair, in whatever part it is
        odd = [(rows[at][0], 1 - rows[at][1], c) if i == at else (a, b, c) for i, (a, b, c) in enumerate(rows)]
        assert inference.unique_sets(make(odd), distinct) == [("a_id", "c_id")]
    many = [(i // 2, 0 if i % 40 == 1 else i % 2, i % 1_000) for i in range(4_000)]
    assert inference.repeating(make(many), [("a_id", "b_id"), ("a_id", "c_id")], distinct) == {("a_id", "b_id")}
    monkeypatch.setattr(inference, "PARTS", 10**9)  # an empty part shows nothing
    assert inference.unique_sets(make(many), distinct) == [("a_id", "c_id")]


def test_values_are_counted_in_parts(spark, monkeypatch):
    """Counts of few and of many values; no aggregation of a proposal sorts the table."""
    from tessera.operators import semantics

    rows = [(i, f"n{i % 700}", i % 3 or None, [0.0, -0.0, float("nan"), None][i % 4]) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, name string, few int, `odd.x` double")
    wanted = list(df.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in df.columns]).first())
    assert semantics.distinct_counts(df) == wanted
    whole = semantics.propose(df, "t")
    monkeypatch.setattr(semantics, "FEW_VALUES", 10)
    assert semantics.distinct_counts(df) == wanted and str(semantics.propose(df, "t")) == str(whole) and semantics.distinct_counts(df.limit(0)) == [0] * 4
