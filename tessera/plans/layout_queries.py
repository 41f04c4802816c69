"""Queries of label tables: the fields of orders as printed and as scanned."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions.hashing import uniform_sql
from tessera.operators import layout
from tessera.plans.registry import query
from tessera.sources.tables import read

_TOP, _LEADING = 200.0, 14.0


def order_fields(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    head = layout.header_fields(orders, "o_orderkey", [
        layout.field("number", F.col("o_orderkey"), F.col("o_orderkey").cast("string"), 40, 60, 12), layout.field("issue_date", F.col("o_orderdate"), F.date_format("o_orderdate", "yyyy-MM-dd"), 40, 80, 9),
        layout.field("total", F.col("o_totalprice"), F.format_string("%.2f", "o_totalprice"), 555, 120, 11, "end"),
    ])
    cells = {"quantity": (F.col("l_quantity"), F.col("l_quantity").cast("long").cast("string"), 300, "end"), "amount": (F.col("l_extendedprice"), F.format_string("%.2f", "l_extendedprice"), 555, "end")}
    lines = layout.line_fields(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], cells, _TOP, _LEADING, 9)
    return head.unionByName(lines)


# digits are 556 wide, points 278 and strokes 333
_WIDE = "(556 * length(regexp_replace(text, '[.-]', '', 'g')) + 278 * (length(text) - length(replace(text, '.', ''))) + 333 * (length(text) - length(replace(text, '-', '')))) * size / 1000"
_FIELDS = f"""
WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r FROM lineitem
), fields AS (
  SELECT o_orderkey AS doc_id, 'number' AS key, CAST(o_orderkey AS VARCHAR) AS text, 40.0 AS x, 60.0 AS y, 12.0 AS size, 0 AS right_side FROM orders
  UNION ALL SELECT o_orderkey, 'issue_date', strftime(o_orderdate, '%Y-%m-%d'), 40.0, 80.0, 9.0, 0 FROM orders
  UNION ALL SELECT o_orderkey, 'total', printf('%.2f', o_totalprice), 555.0, 120.0, 11.0, 1 FROM orders
  UNION ALL SELECT l_orderkey, 'row' || r || '.quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 300.0, {_TOP} + r * {_LEADING}, 9.0, 1 FROM lines
  UNION ALL SELECT l_orderkey, 'row' || r || '.amount', printf('%.2f', l_extendedprice), 555.0, {_TOP} + r * {_LEADING}, 9.0, 1 FROM lines
), placed AS (
  SELECT doc_id, key, text, x - right_side * {_WIDE} AS x0, x + (1 - right_side) * {_WIDE} AS x1, y - 0.75 * size AS y0, y + 0.25 * size AS y1 FROM fields
)
"""


@query("field_boxes", _FIELDS + "SELECT doc_id, key, text, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM placed")
def field_boxes(spark, sf_dir):
    found = layout.boxes(order_fields(spark, sf_dir))
    return found.select("doc_id", "key", "text", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("scanned_boxes", _FIELDS + f""", turned AS (
  SELECT *, (2 * {uniform_sql(9, 'scan/turn', 'doc_id')} - 1) * {math.radians(layout.SCANS['photocopy'][0])} AS t, (2 * {uniform_sql(9, 'scan/shear', 'doc_id')} - 1) * {layout.SCANS['photocopy'][1]} AS s FROM placed
), corners AS (
  SELECT doc_id, key, t, s, unnest([x0, x1, x1, x0]) - 297.5 AS px, unnest([y0, y0, y1, y1]) - 421 AS py FROM turned
)
SELECT doc_id, key, round(greatest(0, min(297.5 + cos(t) * px + (cos(t) * s - sin(t)) * py)), 3) AS bx0, round(greatest(0, min(421 + sin(t) * px + (sin(t) * s + cos(t)) * py)), 3) AS by0,
       round(least(595, max(297.5 + cos(t) * px + (cos(t) * s - sin(t)) * py)), 3) AS bx1, round(least(842, max(421 + sin(t) * px + (sin(t) * s + cos(t)) * py)), 3) AS by1
FROM corners GROUP BY doc_id, key
""")
def scanned_boxes(spark, sf_dir):
    found = layout.scan(layout.boxes(order_fields(spark, sf_dir)), "doc_id", "photocopy", seed=9)
    return found.select("doc_id", "key", *[F.round(c, 3).alias(c) for c in ("bx0", "by0", "bx1", "by1")])
