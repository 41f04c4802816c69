"""Label tables of laid-out documents: which field stands where on a page, and where a scan of the page has it. No drawing.

A field has a key (``total``, ``row3.quantity``), its raw value, a text, a font size and an anchor. Widths come from advance
widths of the characters; right-aligned fields end at their anchor. Words are placed by running sums of the widths before them.
A scan is an affine map of the page; polygons go through it corner by corner, and boxes are their bounds within the page.
Everything is a narrow projection but the numbering of a document's lines, a window within each document.

Coordinates are points from the upper left corner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashing

#: A4 in points; advance widths of Helvetica for the characters from blank to ~, in thousandths of the size.
PAGE = (595.0, 842.0)
WIDTHS = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
#: Other characters are as wide as this.
OTHER = 600
#: Parts of a size above and below the baseline.
ASCENT, DESCENT = 0.75, 0.25
#: Largest turn in degrees and shear of a kind of scan.
SCANS = {"clean": (0.0, 0.0), "office_scan": (0.8, 0.005), "photocopy": (1.5, 0.01), "bad_fax": (2.5, 0.03), "phone_photo": (4.0, 0.06)}


def advance(text: Column, size: Column) -> Column:
    """The width of a text; 0 for an empty or NULL one."""
    table = F.array(*[F.lit(w) for w in WIDTHS])
    one = lambda c: F.coalesce(F.try_element_at(table, F.when(F.ascii(c).between(32, 126), F.ascii(c) - 31).otherwise(F.lit(len(WIDTHS) + 1))), F.lit(OTHER))
    units = F.aggregate(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), F.lit(0), lambda a, c: a + one(c))
    return units * size / 1000.0


def field(key: Column | str, raw: Column, text: Column, x: float, y: Column | float, size: float, align: str = "start") -> Column:
    """A field as a struct; ``align``: ``start`` or ``end``, the side that is at ``x``."""
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), raw.cast("string").alias("raw"), text.alias("text"), F.lit(float(x)).alias("x"), (F.lit(float(y)) if not isinstance(y, Column) else y.cast("double")).alias("y"), F.lit(float(size)).alias("size"), F.lit(align).alias("align"))


def header_fields(docs: DataFrame, doc_id: str, fields: list[Column]) -> DataFrame:
    """doc_id, key, raw, text, x, y, size, align: one row a field of each document."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(F.array(*fields)))


def line_fields(lines: DataFrame, doc_id: str, order: list[str], columns: dict[str, tuple[Column, Column, float, str]], top: float, leading: float, size: float) -> DataFrame:
    """The cells of a document's lines, keyed ``row0.name``, ``row1.name``, ... in ``order``; columns: name -> (raw, text, x, align)."""
    numbered = lines.withColumn("__r", F.row_number().over(Window.partitionBy(doc_id).orderBy(*order)) - 1)
    y = F.lit(top) + F.col("__r") * leading
    cells = [field(F.concat(F.lit("row"), F.col("__r").cast("string"), F.lit(f".{n}")), raw, text, x, y, size, align) for n, (raw, text, x, align) in columns.items()]
    return numbered.select(F.col(doc_id).alias("doc_id"), F.inline(F.array(*cells)))


def boxes(fields: DataFrame) -> DataFrame:
    """``fields`` with ``page`` (from 1) and the box x0, y0, x1, y1 on it. Fields without a text have none and are left out."""
    w = advance(F.col("text"), F.col("size"))
    height = PAGE[1]
    page = F.floor(F.col("y") / height).cast("int") + 1
    y = F.col("y") - (page - 1) * height
    wide = fields.where("text <> ''").withColumn("__w", w).withColumn("page", page).withColumn("__y", y)
    x0 = F.when(F.col("align") == "end", F.col("x") - F.col("__w")).otherwise(F.col("x"))
    return wide.withColumns({"x0": x0, "y0": F.col("__y") - ASCENT * F.col("size"), "x1": x0 + F.col("__w"), "y1": F.col("__y") + DESCENT * F.col("size")}).drop("__w", "__y")


def words(placed: DataFrame) -> DataFrame:
    """One row for each word of each box, with its number and its own box: words follow each other by the widths before them."""
    blank = advance(F.lit(" "), F.col("size"))
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<word:string,from:double,to:double>>").alias("out"))

    def step(acc: Column, word: Column) -> Column:
        w = advance(word, F.col("size"))
        new = F.struct(word.alias("word"), acc["at"].alias("from"), (acc["at"] + w).alias("to"))
        return F.struct((acc["at"] + w + blank).alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

    found = F.aggregate(F.split("text", " "), start, step, lambda acc: acc["out"])
    kept = [c for c in placed.columns if c not in ("x0", "x1")]
    out = placed.select(*kept, "x0", F.posexplode(found).alias("n", "w")).where("w.word <> ''")
    return out.select(*kept, "n", F.col("w.word").alias("word"), (F.col("x0") + F.col("w.from")).alias("x0"), (F.col("x0") + F.col("w.to")).alias("x1"))


def scan_draws(doc_id: Column, kind: str, seed: int = 0) -> tuple[Column, Column]:
    """The turn, in radians, and the shear of each document's scan."""
    if kind not in SCANS:
        raise ValueError(f"unknown scan {kind}; there are {', '.join(SCANS)}")
    most, shear = SCANS[kind]
    return (2 * hashing.uniform(seed, "scan/turn", doc_id) - 1) * math.radians(most), (2 * hashing.uniform(seed, "scan/shear", doc_id) - 1) * shear


def affine(turn: Column, s: Column) -> dict[str, Column]:
    """A turn around the page's centre and a shear, x' = a x + b y + c, y' = d x + e y + f."""
    cx, cy = PAGE[0] / 2, PAGE[1] / 2
    a, b = F.cos(turn), F.cos(turn) * s - F.sin(turn)
    d, e = F.sin(turn), F.sin(turn) * s + F.cos(turn)
    return {"a": a, "b": b, "c": cx - a * cx - b * cy, "d": d, "e": e, "f": cy - d * cx - e * cy}


def scan_map(doc_id: Column, kind: str, seed: int = 0) -> dict[str, Column]:
    """The affine map of each document's scan."""
    return affine(*scan_draws(doc_id, kind, seed))


def scan(placed: DataFrame, doc_id: str, kind: str, seed: int = 0) -> DataFrame:
    """``placed`` as ``scanned`` by the documents' ``scan_map``, whose draws are made once for each row."""
    turn, shear = scan_draws(F.col(doc_id), kind, seed)
    drawn = placed.withColumns({"__turn": turn, "__shear": shear})
    return scanned(drawn, affine(F.col("__turn"), F.col("__shear"))).drop("__turn", "__shear")


def scanned(placed: DataFrame, m: dict[str, Column]) -> DataFrame:
    """``placed`` with ``polygon`` (four corners) and the box bx0, by0, bx1, by1 after the map, bounds kept within the page."""
    mapped = placed.withColumns({f"__{k}": v for k, v in m.items()})  # once for each row, then used by every corner
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    points = {}
    for i, (x, y) in enumerate(corners):
        points[f"__x{i}"] = F.col("__a") * F.col(x) + F.col("__b") * F.col(y) + F.col("__c")
        points[f"__y{i}"] = F.col("__d") * F.col(x) + F.col("__e") * F.col(y) + F.col("__f")
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(top), v))
    ends = {}
    for axis, top in (("x", PAGE[0]), ("y", PAGE[1])):
        values = [F.col(f"__{axis}{i}") for i in range(len(corners))]
        ends |= {f"b{axis}0": inside(F.least(*values), top), f"b{axis}1": inside(F.greatest(*values), top)}
    polygon = F.array(*[F.struct(F.col(f"__x{i}").alias("x"), F.col(f"__y{i}").alias("y")) for i in range(len(corners))])
    return mapped.withColumns(points).withColumns({"polygon": polygon} | ends).drop(*[f"__{k}" for k in m], *points)
