"""The rule language and its plans on small tables whose values matter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import constraints, contracts, integrity, repair, rows
from tessera.operators.rules import language, plain, plans
from tessera.schema import ForeignKey, Graph, Table


def one(spark, df, *texts):
    t, g = {"t": df}, Graph([Table("t")])
    return {r.rule: (r.violations, r.unknown) for r in plans.report(plans.compile_rules(list(texts), t, g), t, g).collect()}


def test_three_valued_logic(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (None, 2.0, None), (3.0, None, "y")], "a double, b double, s string")
    found = one(spark, df, "a < b", "a > b", "a is null => b is null", "a > 100 or b is null", "s = 'x'", "not (a between 1 and 2)")
    assert found == {"R1": (0, 2), "R2": (1, 2), "R3": (1, 0), "R4": (1, 1), "R5": (1, 1), "R6": (1, 1)}


def test_tolerant_equality_and_exact_in(spark):
    df = spark.createDataFrame([(0.3,), (0.304,), (0.31,)], "x double")
    assert one(spark, df, "x = 30%", "x in (0.3)") == {"R1": (1, 0), "R2": (2, 0)}


def test_division_by_zero_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert one(spark, df, "a / b > 3") == {"R1": (1, 1)}


def test_parents_first_match_and_empty_groups(spark):
    orders = spark.createDataFrame([(1, 10.0), (1, 99.0), (2, 0.0)], "id int, total double")
    lines = spark.createDataFrame([(1, 4.0), (1, 6.0), (9, 1.0), (None, 1.0)], "oid int, v double")
    t = {"orders": orders, "lines": lines}
    g = Graph([Table("orders", key=("id",)), Table("lines")], [ForeignKey("lines", ("oid",), "orders", ("id",))])
    found = {r.rule: (r.checked, r.violations, r.unknown) for r in plans.report(plans.compile_rules(["orders.total = SUM(lines.v)", "lines.v < orders.total", "AVG(lines.v) > 1", "COUNT(lines) >= 1"], t, g), t, g).collect()}
    assert found["R1"] == (3, 1, 0)  # no lines sum to 0
    assert found["R2"] == (4, 0, 2)  # no fan-out over the repeated key
    assert found["R3"] == (3, 0, 1)
    assert found["R4"] == (3, 1, 0)


@pytest.mark.parametrize("bad", ["a <", "a < b < c", "(a", "a = 'x", "1 +", "a ? b", "FOO(a)"])
def test_bad_rules_are_refused(spark, bad):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    with pytest.raises(language.RuleError):
        plans.compile_rules([bad], {"t": df}, Graph([Table("t")]))


def test_shown_rules_parse_to_the_same_tree():
    for text in ("a + b * 2 >= 3 and not c is null", "UNIQUE(x)", "s in ('a', 'it''s') => t between 1 and 2", "-x / 4 < ABS(y)"):
        tree = language.parse(text)
        assert language.parse(language.shown(tree)) == tree


def test_plain_sentences():
    columns = ["order_date", "ship_date", "status", "discount", "order"]
    assert plain.translate("discount must be at most 30%", columns) == "discount <= 30%"
    assert plain.translate("The ship date must be after the order date", columns) == "ship_date > order_date"
    assert plain.translate("if status is 'shipped' then ship date is required", columns) == "status = 'shipped' => ship_date is not null"
    assert plain.translate("status must be one of placed, shipped or returned", columns) == "status in ('placed', 'shipped', 'returned')"
    assert plain.translate("ship_date is on or after order date and status cannot be empty", columns) == "ship_date >= order_date and status is not null"
    assert plain.translate("discount must not exceed 5", columns) == "discount <= 5" and plain.translate("discount is no more than 3.", columns) == "discount <= 3"
    assert plain.translate("the ship date is not before the order date", columns) == "ship_date >= order_date"
    assert plain.to_rule("discount < 1", columns) == ("discount < 1", False)
    with pytest.raises(language.RuleError):
        plain.translate("status is shipped", columns)


def test_dict_constraints(spark):
    df = spark.createDataFrame([(1, 17, "a", None), (2, 30, "b", 1.0), (2, 40, "zz", 2.0), (4, None, None, 3.0)], "id int, age int, plan string, v double")
    specs = [{"type": "range", "column": "age", "min": 18, "max": 35}, {"type": "unique", "column": "id"}, {"type": "in_set", "column": "plan", "values": ["a", "b"]}, {"type": "not_null", "column": "v"}, {"type": "regex", "column": "plan", "pattern": "[ab]"}, {"type": "expr", "expr": "v > 1"}]
    found = {r.constraint: r.violations for r in constraints.report(df, specs).collect()}
    assert list(found.values()) == [2, 1, 1, 1, 1, 2, 3]
    assert [r.id for r in constraints.examples(df, specs, ["id", "age"], 2).collect()] == [1, 2]


def test_integrity_of_every_kind(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "pid int")
    kids = spark.createDataFrame([(1, 1), (2, 9), (3, None), (4, 2)], "kid int, pid int")
    g = Graph([Table("parents", key=("pid",)), Table("kids", key=("kid",))], [ForeignKey("kids", ("pid",), "parents", ("pid",), nullable=False)])
    found = {(r.kind, r["on"]): r["count"] for r in integrity.report({"parents": parents, "kids": kids}, g).collect()}
    assert found["null_pk", "parents(pid)"] == 1 and found["duplicate_pk", "parents(pid)"] == 1
    name = g.keys[0].name
    assert found["null_fk", name] == 1 and found["orphan_fk", name] == 1 and found["partial_null_fk", name] == 0


def test_partly_null_composite_keys(spark):
    p = spark.createDataFrame([(1, 1)], "a int, b int")
    c = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, 5, 5)], "id int, a int, b int")
    key = ForeignKey("c", ("a", "b"), "p", ("a", "b"))
    found = {r.kind: r["count"] for r in integrity.reference_faults(c, p, key).collect()}
    assert found == {"null_fk": 0, "partial_null_fk": 1, "orphan_fk": 1}


def test_contract_mostly_and_broken_expectations(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5, 6, 7, 8, 9, -1]], "a int")
    suite = [{"expect": "between", "table": "t", "column": "a", "min": 0, "mostly": 0.9}, {"expect": "between", "table": "t", "column": "a", "min": 0, "mostly": 0.95}, {"expect": "regex", "table": "t", "column": "a", "regex": "("}, {"expect": "not_null", "table": "t", "column": "zz"}, {"expect": "nothing", "table": "t"}, {"expect": "not_null", "table": "u", "column": "a"}]
    found = contracts.run({"t": df}, suite)
    assert [r["success"] for r in found] == [True, False, False, False, False, False]
    assert all(r["error"] for r in found[2:])


def test_repairs(spark):
    day = dt.datetime(2024, 1, 10)
    t = {"t": spark.createDataFrame([(1, 0.5, 5.0, 2.0, day, dt.datetime(2024, 1, 1), "a"), (2, 0.1, 4.0, 2.0, day, None, "b"), (3, 0.2, 1.0, 1.0, day, day, "b")], "id int, d double, x double, y double, s timestamp_ntz, e timestamp_ntz, k string")}
    g = Graph([Table("t", key=("id",))])
    fixed, report = repair.enforce(t, g, ["d <= 30%", "x = y * 2", "e >= s", "UNIQUE(k)"], {"t": "id"}, seed=1)
    assert not any(report.after.values()) and report.before == {"R1": 1, "R2": 2, "R3": 1, "R4": 1}
    out = {r.id: r for r in fixed["t"].collect()}
    assert out[2].e is None and out[1].d <= 0.3 and out[2].k != out[3].k and out[3].x == 2.0


def test_keys_are_never_repaired(spark):
    t = {"t": spark.createDataFrame([(1,), (5,)], "id int")}
    fixed, report = repair.enforce(t, Graph([Table("t", key=("id",))]), ["id < 3"], {"t": "id"})
    assert report.after == {"R1": 1} and report.unrepaired and sorted(r.id for r in fixed["t"].collect()) == [1, 5]


def test_only_queries_may_run(spark):
    spark.range(3).createOrReplaceTempView("nums")
    assert rows.select_only(spark, "select id as update from nums").count() == 3
    for bad in ("drop table nums", "insert into nums values (1)", "create table x as select 1 as a"):
        with pytest.raises(ValueError):
            rows.select_only(spark, bad)


def test_exact_top_k_with_ties(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "id int, s double")
    assert [r.id for r in rows.flag_top(df, F.col("s"), 0.3, "id").where("flag").orderBy("id").collect()] == [0, 1, 2]
