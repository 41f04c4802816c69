"""Boxes, words and scans of laid-out fields against plain arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import layout


def width(text, size):
    return sum(layout.WIDTHS[ord(c) - 32] if 32 <= ord(c) <= 126 else layout.OTHER for c in text) * size / 1000


@pytest.fixture(scope="module")
def fields(spark):
    docs = spark.createDataFrame([(1, "Acme Ltd", 12.5), (2, "été 日", 3.0), (3, "", 7.0), (4, None, 1.0)], "id int, name string, total double")
    text = F.format_string("%.2f", "total")
    head = layout.header_fields(docs, "id", [layout.field("name", F.col("name"), F.col("name"), 40, 60, 12), layout.field("total", F.col("total"), text, 555, 900, 10, "end")])
    lines = spark.createDataFrame([(1, k, k * 1.5) for k in (3, 1, 2)], "id int, line int, amount double")
    return head.unionByName(layout.line_fields(lines, "id", ["line"], {"amount": (F.col("amount"), F.col("amount").cast("string"), 300, "end")}, 200, 14, 9))


def test_boxes_and_keys(fields):
    found = {(r.doc_id, r.key): r for r in layout.boxes(fields).collect()}
    assert {k for i, k in found if i == 1} == {"name", "total", "row0.amount", "row1.amount", "row2.amount"} and (3, "name") not in found and (4, "name") not in found
    for r in found.values():
        w = width(r.text, r.size)
        assert r.x1 - r.x0 == pytest.approx(w) and r.y1 - r.y0 == pytest.approx(r.size)
        assert (r.x1 if r.align == "end" else r.x0) == pytest.approx(r.x)
    assert found[1, "row1.amount"].raw == "3.0" and found[1, "row1.amount"].y == 214
    assert found[1, "total"].page == 2 and found[1, "total"].y1 == pytest.approx(900 - 842 + 2.5) and found[1, "name"].page == 1


def test_words_follow_each_other(fields):
    found = {(r.doc_id, r.n): r for r in layout.words(layout.boxes(fields).where("key = 'name'")).collect()}
    assert [found[k].word for k in sorted(found)] == ["Acme", "Ltd", "été", "日"]
    assert found[1, 0].x1 - found[1, 0].x0 == pytest.approx(width("Acme", 12)) and found[1, 1].x0 == pytest.approx(40 + width("Acme ", 12)) and found[1, 1].x1 == pytest.approx(40 + width("Acme Ltd", 12))


def test_scans_move_corners_and_stay_on_the_page(fields):
    placed = layout.boxes(fields)
    same = layout.scanned(placed, layout.scan_map(F.col("doc_id"), "clean")).collect()
    assert all(r.bx0 == pytest.approx(r.x0) and r.by1 == pytest.approx(r.y1) for r in same)
    turned = layout.scanned(placed, {"a": F.lit(0.0), "b": F.lit(-1.0), "c": F.lit(100.0), "d": F.lit(1.0), "e": F.lit(0.0), "f": F.lit(0.0)}).where("doc_id = 1 and key = 'name'").first()
    assert turned.polygon[0].x == pytest.approx(100 - turned.y0) and turned.polygon[2].y == pytest.approx(turned.x1) and turned.bx1 == pytest.approx(100 - turned.y0)
    for r in layout.scanned(placed, layout.scan_map(F.col("doc_id"), "phone_photo", 3)).collect():
        moved = max(math.dist((r.x0, r.y0), (r.polygon[0].x, r.polygon[0].y)), math.dist((r.x1, r.y1), (r.polygon[2].x, r.polygon[2].y)))
        assert 0 < moved < 80 and 0 <= r.bx0 <= r.bx1 <= layout.PAGE[0] and 0 <= r.by0 <= r.by1 <= layout.PAGE[1]
    with pytest.raises(ValueError, match="unknown scan"):
        layout.scan_map(F.col("doc_id"), "mirror")


def test_draws_of_a_scan_are_made_once_a_row(fields):
    """The same boxes as by the map itself; the plan has each draw once, and no corner is worked in a loop."""
    placed = layout.boxes(fields)
    found = layout.scan(placed, "doc_id", "bad_fax", 5)
    wanted = layout.scanned(placed, layout.scan_map(F.col("doc_id"), "bad_fax", 5))
    assert found.columns == wanted.columns and sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    one = layout.scan(placed.where("key = 'name'"), "doc_id", "bad_fax", 5)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    parts = plan.count("Union") + 1
    assert plan.count("scan/turn") <= 2 * parts and plan.count("scan/shear") <= 2 * parts and "transform(" not in plan
