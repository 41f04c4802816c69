"""Rules, constraints, integrity and contracts over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import constraints, contracts, integrity
from tessera.operators.rules import plans as rules
from tessera.schema import ForeignKey
from tessera.sources.tables import read, tpc, tpc_graph

from .registry import query


def one_rule(text: str, *names: str):
    """A query that reports one rule."""

    def fn(spark, sf_dir):
        tables, graph = tpc(spark, sf_dir, *names), tpc_graph(*names)
        return rules.report(rules.compile_rules([text], tables, graph), tables, graph).select("owner", "checked", "violations", "unknown")

    return fn


def one_rule_sql(owner: str, source: str, truth: str) -> str:
    return f"""SELECT '{owner}' AS owner, count(*) AS checked, CAST(count(*) FILTER (WHERE NOT ({truth})) AS BIGINT) AS violations, CAST(count(*) FILTER (WHERE ({truth}) IS NULL) AS BIGINT) AS unknown FROM {source}"""


RULES = {
    "rule_compare_tolerant": ("l_tax = 0.04", ("lineitem",), "lineitem", "lineitem", "abs(l_tax - 0.04) <= 0.005"),
    "rule_compare_exact_in": ("l_tax in (0.04, 0.05, 1%)", ("lineitem",), "lineitem", "lineitem", "l_tax IN (0.04, 0.05, 0.01)"),
    "rule_compare_text": ("c_mktsegment >= 'C' and c_mktsegment != 'MACHINERY'", ("customer",), "customer", "customer", "c_mktsegment >= 'C' AND c_mktsegment <> 'MACHINERY'"),
    "rule_compare_dates": ("o_orderdate >= '1995-01-01'", ("orders",), "orders", "orders", "o_orderdate >= TIMESTAMP '1995-01-01'"),
    "rule_logic_3vl": ("not (c_acctbal / (c_nationkey - 3) < 100) or c_mktsegment is null", ("customer",), "customer", "customer", "NOT (c_acctbal / nullif(c_nationkey - 3, 0) < 100) OR c_mktsegment IS NULL"),
    "rule_between": ("l_discount between 0.02 and l_tax", ("lineitem",), "lineitem", "lineitem", "l_discount BETWEEN 0.02 AND l_tax"),
    "rule_not_in": ("o_orderstatus not in ('F', 'P')", ("orders",), "orders", "orders", "o_orderstatus NOT IN ('F', 'P')"),
    "rule_implies": ("o_orderstatus = 'F' => o_totalprice > 50000", ("orders",), "orders", "orders", "o_orderstatus <> 'F' OR o_totalprice > 50000"),
    "rule_arith_div0": ("l_quantity / (l_linenumber - 1) > 5", ("lineitem",), "lineitem", "lineitem", "l_quantity / nullif(l_linenumber - 1, 0) > 5"),
    "rule_parent_ref": ("lineitem.l_shipdate >= orders.o_orderdate", ("lineitem", "orders"), "lineitem", "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", "l_shipdate >= o_orderdate"),
    "rule_grandparent_ref": ("l_quantity > 10 or customer.c_acctbal > 0", ("lineitem", "orders", "customer"), "lineitem", "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey", "l_quantity > 10 OR c_acctbal > 0"),
    "rule_far_ancestor": ("customer.c_acctbal > 0 => region.r_name != 'ASIA'", ("customer", "nation", "region"), "customer", "customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", "NOT (c_acctbal > 0) OR r_name <> 'ASIA'"),
    "rule_child_sum": ("o_totalprice >= SUM(lineitem.l_extendedprice * (1 - lineitem.l_discount))", ("lineitem", "orders"), "orders", "orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey", "o_totalprice >= coalesce(s, 0)"),
    "rule_child_count": ("COUNT(lineitem) <= 6", ("lineitem", "orders", "customer"), "orders", "orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey", "coalesce(n, 0) <= 6"),
    "rule_child_avg": ("o_totalprice > 0 => AVG(lineitem.l_quantity) < 30", ("lineitem", "orders"), "orders", "orders LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS a FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey", "NOT (o_totalprice > 0) OR a < 30"),
    "rule_child_minmax": ("MAX(lineitem.l_shipdate) >= orders.o_orderdate and MIN(lineitem.l_quantity) < 20", ("lineitem", "orders"), "orders", "orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m, min(l_quantity) AS q FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey", "m >= o_orderdate AND q < 20"),
    "rule_grandchild_sum": ("c_acctbal < SUM(lineitem.l_quantity) * 10", ("lineitem", "orders", "customer"), "customer", "customer LEFT JOIN (SELECT o_custkey, sum(l_quantity) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) ON o_custkey = c_custkey", "c_acctbal < coalesce(s, 0) * 10"),
    "rule_scalar_funcs": ("ABS(l_quantity - 25) < ROUND(l_extendedprice / 1000, 0) and LEN(l_returnflag) = 1 and UPPER(l_linestatus) = 'O'", ("lineitem",), "lineitem", "lineitem", "abs(l_quantity - 25) < round_even(l_extendedprice / 1000, 0) AND abs(length(l_returnflag) - 1) <= 0.005 AND upper(l_linestatus) = 'O'"),
    "rule_datediff": ("DATEDIFF(lineitem.l_shipdate, orders.o_orderdate) <= 120.5", ("lineitem", "orders"), "lineitem", "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", "(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0 <= 120.5"),
    "rule_unique": ("UNIQUE(o_custkey)", ("orders",), "orders", "(SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)", "r = 1"),
}
for _name, (_text, _tables, _owner, _source, _truth) in RULES.items():
    query(_name, one_rule_sql(_owner, _source, _truth))(one_rule(_text, *_tables))

SUITE = {
    "total_covers_lines": "o_totalprice >= SUM(lineitem.l_extendedprice * (1 - lineitem.l_discount))",
    "few_lines": "COUNT(lineitem) <= 6 and o_totalprice > 0",
    "ships_after_order": "lineitem.l_shipdate >= orders.o_orderdate",
    "small_discount": "l_discount <= 8%",
    "known_status": "o_orderstatus in ('F', 'O')",
    "balance": "c_acctbal >= 0 => c_mktsegment != 'BUILDING'",
}


@query("rule_suite_report", """
WITH o AS (SELECT o.*, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey),
l AS (SELECT * FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
SELECT 'total_covers_lines' AS rule, 'orders' AS owner, 'bound' AS kind, count(*) AS checked, count(*) FILTER (WHERE NOT (o_totalprice >= s)) AS violations, CAST(0 AS BIGINT) AS unknown FROM o
UNION ALL SELECT 'few_lines', 'orders', 'check', count(*), count(*) FILTER (WHERE NOT (n <= 6 AND o_totalprice > 0)), 0 FROM o
UNION ALL SELECT 'known_status', 'orders', 'bound', count(*), count(*) FILTER (WHERE NOT (o_orderstatus IN ('F', 'O'))), 0 FROM o
UNION ALL SELECT 'ships_after_order', 'lineitem', 'bound', count(*), count(*) FILTER (WHERE NOT (l_shipdate >= o_orderdate)), count(*) FILTER (WHERE (l_shipdate >= o_orderdate) IS NULL) FROM l
UNION ALL SELECT 'small_discount', 'lineitem', 'bound', count(*), count(*) FILTER (WHERE NOT (l_discount <= 0.08)), 0 FROM l
UNION ALL SELECT 'balance', 'customer', 'conditional', count(*), count(*) FILTER (WHERE NOT (NOT c_acctbal >= 0 OR c_mktsegment <> 'BUILDING')), 0 FROM customer
""")
def rule_suite_report(spark, sf_dir):
    names = ("lineitem", "orders", "customer")
    tables, graph = tpc(spark, sf_dir, *names), tpc_graph(*names)
    return rules.report(rules.compile_rules(SUITE, tables, graph), tables, graph)


@query("rule_violation_rows", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT (NOT c_acctbal >= 0 OR c_mktsegment <> 'BUILDING')")
def rule_violation_rows(spark, sf_dir):
    tables, graph = tpc(spark, sf_dir, "customer"), tpc_graph("customer")
    return rules.violations(rules.compile_rules([SUITE["balance"]], tables, graph)[0], tables, graph)


CONSTRAINTS = {
    "constraint_range": ("customer", {"type": "range", "column": "c_acctbal", "min": 0, "max": 9000}, "c_acctbal < 0 OR c_acctbal > 9000"),
    "constraint_not_null": ("customer", {"type": "not_null", "column": "c_mktsegment"}, "c_mktsegment IS NULL"),
    "constraint_in_set": ("customer", {"type": "in_set", "column": "c_mktsegment", "values": ["BUILDING", "AUTOMOBILE"]}, "c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')"),
    "constraint_regex": ("part", {"type": "regex", "column": "p_brand", "pattern": "Brand#[1-3]"}, "NOT regexp_matches(p_brand, '^(?:Brand#[1-3])')"),
    "constraint_expr": ("part", {"type": "expr", "expr": "p_retailprice > 100 * nullif(p_size, 7)"}, "NOT coalesce(p_retailprice > 100 * nullif(p_size, 7), false)"),
}


def _constraint(table: str, spec: dict):
    def fn(spark, sf_dir):
        return constraints.report(read(spark, sf_dir, table), [spec]).where("constraint <> 'any'")

    return fn


def _pass(bad: str, n: str = "count(*)") -> str:
    return f"round(100 * (1 - {bad} / {n}), 4)"


for _name, (_table, _spec, _bad) in CONSTRAINTS.items():
    _label = constraints.label(_spec).replace("'", "''")
    _count = f"count(*) FILTER (WHERE {_bad})"
    query(_name, f"SELECT '{_label}' AS \"constraint\", {_count} AS violations, count(*) AS rows, {_pass(_count)} AS pass_pct FROM {_table}")(_constraint(_table, _spec))


@query("constraint_unique", """
SELECT 'unique:o_custkey' AS "constraint", count(*) FILTER (WHERE r > 1) AS violations, count(*) AS rows, round(100 * (1 - count(*) FILTER (WHERE r > 1) / count(*)), 4) AS pass_pct
FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
""")
def constraint_unique(spark, sf_dir):
    return constraints.report(read(spark, sf_dir, "orders"), [{"type": "unique", "column": "o_custkey"}], ["o_orderkey"]).where("constraint <> 'any'")


@query("constraint_examples", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0 OR c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') ORDER BY c_custkey LIMIT 5
""")
def constraint_examples(spark, sf_dir):
    specs = [{"type": "range", "column": "c_acctbal", "min": 0}, {"type": "in_set", "column": "c_mktsegment", "values": ["BUILDING", "AUTOMOBILE"]}]
    return constraints.examples(read(spark, sf_dir, "customer"), specs, ["c_custkey"])


@query("integrity_report", """
SELECT 'null_pk' AS kind, 'orders(o_orderkey)' AS "on", count(*) FILTER (WHERE o_orderkey IS NULL) AS "count" FROM orders
UNION ALL SELECT 'duplicate_pk', 'orders(o_orderkey)', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'null_pk', 'lineitem(l_orderkey,l_linenumber)', count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) FROM lineitem
UNION ALL SELECT 'duplicate_pk', 'lineitem(l_orderkey,l_linenumber)', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'null_fk', 'lineitem(l_orderkey)->orders(o_orderkey)', 0
UNION ALL SELECT 'partial_null_fk', 'lineitem(l_orderkey)->orders(o_orderkey)', 0
UNION ALL SELECT 'orphan_fk', 'lineitem(l_orderkey)->orders(o_orderkey)', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000)
""")
def integrity_report(spark, sf_dir):
    tables = tpc(spark, sf_dir, "orders", "lineitem")
    graph = tpc_graph("orders", "lineitem")
    graph.tables["lineitem"].key = ("l_orderkey", "l_linenumber")
    keys = [integrity.key_faults(n, tables[n], graph.tables[n].key) for n in ("orders", "lineitem")]
    refs = integrity.reference_faults(tables["lineitem"], tables["orders"].where("o_totalprice > 1000"), graph.keys[0])
    return keys[0].unionByName(keys[1]).unionByName(refs)


@query("orphan_examples", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 20) ORDER BY ALL LIMIT 5
""")
def orphan_examples(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    key = ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",))
    return integrity.examples({"lineitem": lines, "part": read(spark, sf_dir, "part").where("p_size > 20")}, key)


CONTRACT = [
    ({"expect": "row_count_between", "table": "orders", "min": 1, "max": 10}, "SELECT NULL, NULL, NULL, CAST(count(*) AS DOUBLE), count(*) BETWEEN 1 AND 10 FROM orders"),
    ({"expect": "column_exists", "table": "orders", "column": "o_custkey"}, "SELECT 'o_custkey', NULL, NULL, NULL, true"),
    ({"expect": "columns_match_set", "table": "orders", "columns": ["o_orderkey"], "exact": False}, "SELECT NULL, NULL, NULL, NULL, true"),
    ({"expect": "not_null", "table": "orders", "column": "o_totalprice"}, "SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS NULL), count(*), NULL, count(*) FILTER (WHERE o_totalprice IS NULL) = 0 FROM orders"),
    ({"expect": "unique", "table": "orders", "column": "o_custkey"}, "SELECT 'o_custkey', count(*) FILTER (WHERE n > 1), count(*), NULL, count(*) FILTER (WHERE n > 1) = 0 FROM (SELECT count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"),
    ({"expect": "between", "table": "orders", "column": "o_totalprice", "min": 1000, "max": 300000, "mostly": 0.5}, "SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 300000), count(o_totalprice), NULL, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 300000) <= 0.5 * count(o_totalprice) FROM orders"),
    ({"expect": "in_set", "table": "orders", "column": "o_orderstatus", "values": ["F", "O"], "mostly": 0.6}, "SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(o_orderstatus), NULL, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) <= 0.4 * count(o_orderstatus) FROM orders"),
    ({"expect": "regex", "table": "orders", "column": "o_orderpriority", "regex": "[1-5]-[A-Z ]+"}, "SELECT 'o_orderpriority', count(*) FILTER (WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')), count(o_orderpriority), NULL, count(*) FILTER (WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')) = 0 FROM orders"),
    ({"expect": "of_type", "table": "orders", "column": "o_orderkey", "type": "float"}, "SELECT 'o_orderkey', NULL, NULL, NULL, true"),
    ({"expect": "pair_greater", "table": "lineitem", "a": "l_discount", "b": "l_tax", "or_equal": True}, "SELECT NULL, count(*) FILTER (WHERE l_discount < l_tax), count(*), NULL, count(*) FILTER (WHERE l_discount < l_tax) = 0 FROM lineitem"),
    ({"expect": "in_other_table", "table": "lineitem", "column": "l_suppkey", "other": "supplier", "other_column": "s_suppkey"}, "SELECT 'l_suppkey', count(*) FILTER (WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)), count(l_suppkey), NULL, count(*) FILTER (WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) = 0 FROM lineitem"),
    ({"expect": "mean_between", "table": "lineitem", "column": "l_quantity", "min": 20, "max": 30}, "SELECT 'l_quantity', NULL, NULL, round(avg(l_quantity), 6), avg(l_quantity) BETWEEN 20 AND 30 FROM lineitem"),
    ({"expect": "proportion_true", "table": "lineitem", "column": "l_linenumber", "min": 0.9, "max": 1}, "SELECT 'l_linenumber', NULL, NULL, round(avg(CAST(l_linenumber = 1 AS DOUBLE)), 6), avg(CAST(l_linenumber = 1 AS DOUBLE)) BETWEEN 0.9 AND 1 FROM lineitem"),
    ({"expect": "equals_child_sum", "table": "orders", "column": "o_totalprice", "key": "o_orderkey", "child": "lineitem", "child_key": "l_orderkey", "child_value": "l_extendedprice", "tolerance": 1000}, "SELECT 'o_totalprice', count(*) FILTER (WHERE abs(o_totalprice - coalesce(s, 0)) > 1000), count(o_totalprice), NULL, count(*) FILTER (WHERE abs(o_totalprice - coalesce(s, 0)) > 1000) = 0 FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey"),
]


def _contract_sql(items) -> str:
    parts = [f"SELECT '{e['expect']}' AS expect, '{e['table']}' AS \"table\", CAST(c AS VARCHAR) AS \"column\", ok AS success, CAST(coalesce(u, 0) AS BIGINT) AS unexpected, CAST(coalesce(t, 0) AS BIGINT) AS total, CAST(coalesce(o, -1) AS DOUBLE) AS observed FROM ({sql}) AS x(c, u, t, o, ok)" for e, sql in items]
    return " UNION ALL ".join(parts)


def _contract(items):
    def fn(spark, sf_dir):
        tables = tpc(spark, sf_dir, "orders", "lineitem", "supplier")
        found = contracts.as_frame(spark, contracts.run(tables, [e for e, _ in items]))
        return found.select("expect", "table", "column", "success", F.coalesce("unexpected", F.lit(0)).alias("unexpected"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.round("observed", 6), F.lit(-1.0)).alias("observed"))

    return fn


query("contract_suite", _contract_sql(CONTRACT))(_contract(CONTRACT))
for _item in CONTRACT:
    query(f"contract_{_item[0]['expect']}", _contract_sql([_item]))(_contract([_item]))
