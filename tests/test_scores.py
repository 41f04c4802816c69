"""Privacy, cross-table effects and classification metrics against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import relations, scoring, stats
from tessera.schema import ForeignKey, Graph, Table
from tessera.session import checkpoints


def people(seed, n, shift=0.0):
    r = random.Random(seed)
    return [(i, r.gauss(50, 10) + shift, r.choice("abc"), r.randrange(4)) for i in range(n)]


def vectors(rows, train):
    xs, zs = [x[1] for x in train], [x[3] for x in train]
    mx, sx, mz, sz = statistics.median(xs), statistics.pstdev(xs), statistics.median(zs), statistics.pstdev(zs)
    return [[(x[1] - mx) / sx, (x[3] - mz) / sz, *[float(x[2] == k) for k in "abc"]] for x in rows]


def closest(rows, others):
    return [min(math.dist(a, b) for b in others) for a in rows]


def test_privacy_against_brute_force(spark):
    train, synthetic, holdout = people(1, 150), people(2, 200), people(3, 90)
    synthetic[:6] = [(i, *train[i][1:]) for i in range(6)]  # copies
    synthetic[6] = (6, train[6][1] + 1e-4, *train[6][2:])  # all but a copy
    train += [(200 + i, 1.0, "a", 1) for i in range(3)]  # repeated by chance
    make = lambda rows: spark.createDataFrame(rows, "__id long, x double, c string, z int")
    found = scoring.privacy(make(train), make(synthetic), make(holdout))
    tv, sv, hv = (vectors(x, train) for x in (train, synthetic, holdout))
    dcr, base = closest(sv, tv), statistics.median(closest(hv, tv))
    assert found["median_distance"] == pytest.approx(statistics.median(dcr)) and found["baseline_distance"] == pytest.approx(base)
    assert found["copies"] == {"any": 6 / 200, "chance": 3 / 153, "excess": pytest.approx(6 / 200 - 3 / 153)}
    assert found["near_duplicates"] == sum(d <= 0.05 * base for d in dcr) and (6, 6) in {(a, b) for a, b, _ in found["flagged"]}
    assert found["parts"]["copies"] == pytest.approx(100 * (1 - 20 * (6 / 200 - 3 / 153)))
    assert 0.4 < found["auc"] < 0.65 and found["score"] > 70
    without = scoring.privacy(make(train), make(synthetic))
    assert without["auc"] is None and without["baseline"] == "half" and without["parts"]["distance"] > 70
    leak = scoring.privacy(make(train), make(train), make(holdout))
    assert leak["auc"] > 0.9 and leak["parts"]["distance"] < 5 and leak["parts"]["copies"] == 0 and leak["near_duplicates"] >= 150


def brute_auc(labels, scores, k):
    pos, neg = [s for y, s in zip(labels, scores, strict=True) if y == k], [s for y, s in zip(labels, scores, strict=True) if y != k]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_of_every_class_and_macro_f1(spark):
    r = random.Random(4)
    rows = [(r.choice([0, 0, 0, 1, 2]), r.choice([0, 1, 2, 3]), *[r.randrange(6) / 5 for _ in range(3)]) for _ in range(300)] + [(None, 0, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "y int, p int, s0 double, s1 double, s2 double")
    found = stats.auc_by_class(df, "y", [0, 1, 2, 9], {0: F.col("s0"), 1: F.col("s1"), 2: F.col("s2"), 9: F.col("s0")})
    real = rows[:-1]
    for k in range(3):
        assert found[k] == pytest.approx(brute_auc([x[0] for x in real], [x[2 + k] for x in real], k))
    assert found[9] is None
    f1 = []
    for k in range(4):
        tp, said, is_k = sum(x[0] == x[1] == k for x in real), sum(x[1] == k for x in real), sum(x[0] == k for x in real)
        f1.append(2 * tp / (said + is_k))
    assert stats.confusion(df, "y", "p") == {"accuracy": pytest.approx(sum(x[0] == x[1] for x in real) / 300), "macro_f1": pytest.approx(sum(f1) / 4)}


def test_train_on_synthetic_sees_worse_data(spark):
    r = random.Random(6)

    def rows(n, noise):
        out = []
        for _ in range(n):
            x, c = r.gauss(0, 1), r.choice("pq")
            score = x + (c == "p") + r.gauss(0, 0.3)
            label = "low" if score < 0 else "mid" if score < 1 else "top"
            out.append((x, c, label if r.random() >= noise else r.choice(["low", "mid", "top"])))
        return spark.createDataFrame(out, "x double, c string, y string")

    found = scoring.tstr(rows(300, 0.0), rows(300, 0.0), rows(300, 0.9), "y")
    assert found["task"] == "classification" and found["primary"] == "auc" and found["mean_gap_pct"] > 2
    for m in found["models"].values():
        assert m["real"]["auc"] > 0.9 and m["real"]["macro_f1"] > 0.7 and m["gaps"]["macro_f1"] > 0
    assert scoring.gap("rmse", 2.0, 3.0) == 50 and scoring.gap("r2", 0.8, 0.4) == 50 and scoring.gap("auc", None, 1.0) is None


def family_of(spark, seed, linked=True):
    """Regions over customers over orders; a region's kind and a customer's score tell the order's value."""
    checkpoints(spark)
    r = random.Random(seed)
    regions = [(i, "NS"[i % 2]) for i in range(70)]
    customers = [(i, r.randrange(70) if i % 9 else None, r.gauss(0, 1)) for i in range(300)]
    orders = []
    for i in range(1_500):
        c = r.choice(customers)
        north = c[1] is not None and c[1] % 2 == 0
        orders.append((i, c[0], (40 * north + 10 * c[2] if linked else 0.0) + r.gauss(0, 5)))
    tables = {"regions": spark.createDataFrame(regions, "region_id int, kind string"), "customers": spark.createDataFrame(customers, "customer_id int, region_id int, score double"), "orders": spark.createDataFrame(orders, "order_id int, customer_id int, value double")}
    graph = Graph([Table("regions", {}, ("region_id",)), Table("customers", {}, ("customer_id",)), Table("orders", {}, ("order_id",))], [ForeignKey("customers", ("region_id",), "regions", ("region_id",)), ForeignKey("orders", ("customer_id",), "customers", ("customer_id",))])
    return tables, graph


def test_effects_reach_over_two_tables(spark):
    real, graph = family_of(spark, 1)
    found = {e.pair: e for e in relations.measured(real, graph)}
    eta = found["group", "orders", "value", "regions", "kind"]
    rank = found["rank", "orders", "value", "customers", "score"]
    rows = real["orders"].join(real["customers"], "customer_id").join(real["regions"], "region_id", "left").toPandas()
    assert rank.value == pytest.approx(rows["score"].rank().corr(rows["value"].rank()))
    known = rows.dropna(subset=["kind"])
    total = ((known["value"] - known["value"].mean()) ** 2).sum()
    groups = known.groupby("kind")["value"]
    assert eta.value == pytest.approx(float((groups.size() * (groups.mean() - known["value"].mean()) ** 2).sum() / total)) and eta.means == pytest.approx(groups.mean().to_dict())
    score, details = relations.cross_table(real, family_of(spark, 2)[0], graph)
    assert score > 80 and details[0]["ancestor_column"] == "kind"
    worse, _ = relations.cross_table(real, family_of(spark, 2, linked=False)[0], graph)
    assert worse < 30
    sizes = relations.join_sizes(real, graph)
    assert sizes == {("regions", "customers"): pytest.approx(266 / 70), ("customers", "orders"): 5.0, ("regions", "orders"): pytest.approx(len(known) / 70)}
