"""Relational generation: draws by weight, distinct partners, strata, dependence on ancestors, exact numbers of rows."""

import collections

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import inference, integrity, relational, stats
from tessera.schema import ForeignKey, Graph, Table
from tessera.session import checkpoints
from tessera.sources import datasets


def test_positions_meet_the_part_that_holds_them(spark):
    weights = [0, 5, 1, 0, 200, 3, 1]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "k long, w long")
    placed, total, n = relational.parts(df, "k", "w")
    assert (total, n) == (210, 5)
    found = relational.located(spark.range(-1, 212), "id", placed, "w", total, n).collect()
    wanted = [i for i, w in enumerate(weights) for _ in range(w)]
    assert len(found) == 213 and {r.id: r.k for r in found} == {-1: None, 210: None, 211: None, **dict(enumerate(wanted))}


@pytest.mark.parametrize("k", [1, 3, 30, 40])
def test_partners_are_distinct_and_by_weight(spark, k):
    """Few of them by redrawing, many or all by exponential keys; one partner holds a third of the weight."""
    checkpoints(spark)
    weights = spark.range(40).select(F.col("id").alias("__id"), F.when(F.col("id") == 7, 20).otherwise(1).cast("long").alias("__w"))
    slots = spark.range(200 * k).select(F.col("id").alias("__id"), F.floor(F.col("id") / k).cast("long").alias("__parent"), F.lit(k).alias("__k"))
    found = relational.distinct_partners(slots, weights, 3, "x").collect()
    assert sorted(r["__id"] for r in found) == list(range(200 * k))
    mine = collections.defaultdict(list)
    for r in found:
        mine[r["__parent"]].append(r["__ref"])
    assert all(len(set(v)) == k for v in mine.values()) and {p for v in mine.values() for p in v} <= set(range(40))
    share = sum(7 in v for v in mine.values()) / 200
    one = 20 / 59
    assert share == 1 if k == 40 else share > 0.95 if k == 30 else abs(share - one) < 0.12 if k == 1 else share > one


def dependent(spark, n=600):
    """Customers whose segment tells how many orders they have and how large those are; orders may lack a clerk."""
    u = lambda s, c="id": hashing.uniform(1, s, F.col(c))
    customers = spark.range(n).select((F.col("id") + 1).alias("customer_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.floor(u("s") * 3) + 1).cast("int")).alias("segment"), (u("x") * 100).alias("score"))
    counts = customers.withColumn("m", F.when(F.col("segment") == "a", 1).when(F.col("segment") == "b", 4).otherwise(8) + F.floor(u("k", "customer_id") * 3))
    orders = counts.select("customer_id", "segment", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("line"))
    number = F.col("customer_id") * 100 + F.col("line")
    orders = orders.select(number.alias("order_id"), "customer_id", F.when(hashing.uniform(2, "c", number) < 0.8, (F.floor(hashing.uniform(2, "d", number) ** 3 * 20) + 1).cast("long")).alias("clerk_id"),
                           (F.when(F.col("segment") == "c", 100.0).when(F.col("segment") == "a", 50.0).otherwise(10.0) + 15 * hashing.gaussian(2, "v", number)).alias("total"))
    clerks = spark.range(20).select((F.col("id") + 1).alias("clerk_id"), F.concat(F.lit("clerk "), F.col("id")).alias("name"))
    graph = Graph([Table("customers", {}, ("customer_id",)), Table("clerks", {}, ("clerk_id",)), Table("orders", {}, ("order_id",))],
                  [ForeignKey("orders", ("customer_id",), "customers", ("customer_id",), nullable=False), ForeignKey("orders", ("clerk_id",), "clerks", ("clerk_id",))])
    return {"customers": customers, "clerks": clerks, "orders": orders.checkpoint()}, graph


def effect(tables, y):
    return stats.eta2(tables["orders"].join(tables["customers"], "customer_id"), "segment", y).first()["eta2"]


@pytest.fixture(scope="module")
def learned(spark):
    checkpoints(spark)
    tables, graph = dependent(spark)
    return tables, graph, relational.fit(tables, graph)


def test_children_depend_on_their_parents(spark, learned):
    tables, graph, model = learned
    made = relational.generate_all(model, seed=4)
    assert made.integrity().agg(F.sum("count")).first()[0] == 0 and made.notes == []
    assert abs(effect(tables, "total") - effect(made.tables, "total")) < 0.15
    per = lambda t: t["customers"].join(inference.children(t["orders"], t["customers"], graph.keys[0]), "customer_id")
    strata = model.strata[graph.keys[0].name]
    assert (strata.table, strata.column) == ("customers", "segment")
    real, ours = (stats.eta2(per(t), "segment", "children").first()["eta2"] for t in (tables, made.tables))
    assert strata.effect == pytest.approx(real) and abs(real - ours) < 0.1
    apart = relational.generate_all(relational.fit(tables, graph, depend=False), seed=4)
    assert effect(apart.tables, "total") < 0.1
    none = made.tables["orders"].agg(F.avg(F.col("clerk_id").isNull().cast("double"))).first()[0]
    assert abs(none - 0.2) < 0.05
    shares = lambda t: sorted(r["count"] / t["orders"].count() for r in t["orders"].groupBy("clerk_id").count().collect() if r.clerk_id is not None)
    a, b = shares(tables), shares(made.tables)
    assert max(b) > 0.08 and abs(max(a) - max(b)) < 0.2  # some clerks are popular, and not the same number as before


def test_rows_are_fixed_and_repeatable(spark, learned):
    _, _, model = learned
    made = relational.generate_all(model, rows={"customers": 150, "orders": 777}, seed=5)
    assert {t: df.count() for t, df in made.tables.items()} == {"customers": 150, "clerks": 20, "orders": 777}
    again = relational.generate_all(model, rows={"customers": 150, "orders": 777}, seed=5)
    assert made.tables["orders"].exceptAll(again.tables["orders"]).count() == 0
    fixed = relational.generate_all(model, rows={"customers": 40}, seed=5, cardinality={model.graph.keys[0].name: {"kind": "fixed", "value": 3}})
    assert fixed.tables["orders"].count() == 120


def test_rules_hold_over_generated_tables(spark, learned):
    _, _, model = learned
    made = relational.generate_all(model, rows={"customers": 60}, seed=5, rules=["orders.total >= 20"])
    assert made.rules is not None and made.tables["orders"].where("total < 20").count() == 0


def test_junctions_composite_references_lines_and_forests(spark):
    """A junction; lines with a composite reference to it; employees under employees; nulls in a column."""
    checkpoints(spark)
    people = spark.createDataFrame([(f"P{i:03d}", None if i % 7 == 0 else f"P{i // 3:03d}", None if i % 4 == 0 else float(i)) for i in range(60)], "id string, boss string, pay double")
    tags = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(12)], "tag int, kind string")
    both = spark.createDataFrame([(f"P{i:03d}", j, (i * j) % 5) for i in range(60) for j in range(12) if (i + j) % 3 == 0 or i % 10 == 0], "id string, tag int, weight int")
    notes = spark.createDataFrame([(f"P{i:03d}", j, n, float(n)) for i in range(60) for j in range(12) if i % 10 == 0 for n in range(1, 1 + (i + j) % 4)], "id string, tag int, line int, value double")
    keys = [ForeignKey("people", ("boss",), "people", ("id",)), ForeignKey("both", ("id",), "people", ("id",)), ForeignKey("both", ("tag",), "tags", ("tag",)), ForeignKey("notes", ("id", "tag"), "both", ("id", "tag"))]
    graph = Graph([Table("people", {}, ("id",)), Table("tags", {}, ("tag",)), Table("both", {}, ("id", "tag")), Table("notes", {}, ("id", "tag", "line"))], keys)
    made = relational.generate_all(relational.fit({"people": people, "tags": tags, "both": both, "notes": notes}, graph), scale=2.0, seed=1)
    assert integrity.report(made.tables, graph).agg(F.sum("count")).first()[0] == 0
    t = made.tables
    assert t["people"].count() == 120 and 10 < t["people"].where("pay is null").count() < 60
    assert t["people"].where("boss >= id").count() == 0 and t["people"].where("boss is null").count() >= 1
    assert t["both"].count() == t["both"].select("id", "tag").distinct().count() > 300
    lines = t["notes"].groupBy("id", "tag").agg(F.max("line").alias("m"), F.count("line").alias("n"))
    assert lines.where("m <> n").count() == 0 and t["notes"].count() > 20


def test_null_conditions_nothing_and_comoments(spark):
    """A NULL given leaves the other columns at their own middle, and co-moments in arrays are those of the rows where both are present."""
    import numpy as np

    from tessera.operators import generate, stats

    grid = [float(i) for i in range(101)]
    model = generate.Copula([generate.Profile(n, "numeric", "double", grid=grid) for n in "xy"], np.array([[1.0, 0.95], [0.95, 1.0]]), [(0.0, 1.0)] * 2)
    rows = spark.range(2_000).selectExpr("id AS k", "CASE WHEN id % 2 = 0 THEN 99.0D END AS x")
    got = {r["none"]: r["m"] for r in generate.sample_given(model, rows, "k", ["x"]).selectExpr("x IS NULL AS none", "y").groupBy("none").agg({"y": "avg"}).toDF("none", "m").collect()}
    assert 45 < got[True] < 55 and got[False] > 85
    values = [(float(i), float(i * i % 17), 4.0) if i % 5 else (float(i), None, 4.0) for i in range(100)]
    found = stats.comoments(spark.createDataFrame(values, "a double, b double, c double").repartition(3), ["a", "b", "c"])
    both = np.array([v[:2] for v in values if v[1] is not None])
    assert abs(found.correlation(0, 1) - np.corrcoef(both.T)[0, 1]) < 1e-12 and found.correlation(0, 2) is None
    assert type(found.correlation(0, 1)) is float and found.n[0, 1] == len(both) and abs(found.deviation(0) - np.std(range(100))) < 1e-9
