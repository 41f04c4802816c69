"""Personal data, hard negatives and whitening against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives, pii, queries, whitening

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    number = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(number))]
        return 12 <= len(number) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(number) <= 15


def base_spans(text):
    found = [(m.start(), at, m.end(), k) for at, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if holds(k, m.group())]
    return [(k, a, b) for a, _, b, k in sorted(found)]


PARTS = ["a.b+c@d-e.f", "x@y", "@q.r", "p@q.r@s.t.u", "é@ü.com", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8", "9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "0 0 0 0 0 0 0 0 0 0 0 0", "4" * 30,
         "+1 (487) 555-7209", "+44 20 7946 0958 1234 5678", "+1", "+12 345", "++33.1.23.45.67.89-", "DE89 3704 0044 0532 0130 00 AND MORE", "DE88370400440532013000", "ssn 078-05-1120", "SSN 666-05-1120", "invoice 078-05-1120",
         "call 555-123-4567", "order 555-123-4567", "日本", " ", ",", "\n", "1", "0", "-", "."]


def awkward(n=400, seed=4):
    r = random.Random(seed)
    return [None, "", " ", "@", "+", *["".join(r.choice(PARTS) + r.choice(["", " ", "", ", "]) for _ in range(r.randrange(1, 12))) for _ in range(n)], "é" * 30_000 + " a@b.c " + "7" * 40_000 + " " + "x" * 60_000 + "@"]


@pytest.fixture(scope="module")
def private(spark):
    rows = [(i, t) for i, t in enumerate(awkward())] + [(7, "again +1 (487) 555-7209"), (7, "again +1 (487) 555-7209"), (None, "a@b.c")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "kind", "base", "start")}).repartition(4)


def test_personal_data_against_plain_patterns(private):
    found = [(r.doc_id, [(x.kind, x.start, x.end) for x in r.spans if x.base]) for r in pii.personal_data(private).collect()]
    assert sorted(found, key=str) == sorted(((r.doc_id, base_spans(r.text or "")) for r in private.collect()), key=str)
    for text in [t or "" for t in awkward(900, 5)]:
        spans = pii.spans(text)
        assert [(k, a, b) for k, a, b, _, base in spans if base] == base_spans(text)
        assert all(not (a < d and c < b) for k, a, b, _, base in spans if not base for _, c, d, _, other in spans if other)


def test_further_spans_need_check_digits_and_words():
    of = lambda t: [(k, t[a:b]) for k, a, b, _, base in pii.spans(t) if not base]
    assert of("pay to DE89 3704 0044 0532 0130 00 AND MORE") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert of("pay to DE88 3704 0044 0532 0130 00") == []
    assert of("my SSN is 078-05-1120.") == [("social", "078-05-1120")] and of("part 078-05-1120") == [] and of("SSN 000-05-1120") == []
    assert of("Phone: 555-123-4567") == [("local_phone", "555-123-4567")] and of("order 555-123-4567, phone") == []
    score = {p for _, _, _, p, _ in pii.spans("card 5500000000000004")} | {p for _, _, _, p, _ in pii.spans("order 5500000000000004")} | {p for _, _, _, p, _ in pii.spans("5500000000000004")}
    assert score == {100, 40, 70}


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame([(1, "write a@b.c or +1 (487) 555-7209!", 5), (2, None, 6), (3, "", 7), (3, "nothing", 8)], "doc_id long, text string, masked int")
    out = pii.redacted(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == [(1, "write [email] or [phone]!", 5), (2, None, 6), (3, "", 7), (3, "nothing", 8)]


def test_personal_data_query_equals_its_sql(spark, private, tmp_path):
    private.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_personal_data(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        wanted = con.sql(queries.ORACLES["op11_personal_data"])
        order = [wanted.columns.index(c) for c in found.columns]
        wanted = [tuple(r[i] for i in order) for r in wanted.fetchall()]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


def mined(rows, asked, kp=5, kn=5, scale=256):
    ok = [(i, la, [int(np.floor(scale * x)) for x in v]) for i, la, v in rows if i is not None and la is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for i, la, v in ok:
        if not asked(i):
            continue
        scored = [(-dot(v, w), j, lb) for j, lb, w in ok]
        for s, j in sorted((s, j) for s, j, lb in scored if lb == la and j != i)[:kp]:
            p = -s
            best = sorted((t, k) for t, k, lb in scored if lb != la and 80 * p <= -100 * t <= 100 * p)[:kn]
            out += [(i, j, rank, k, p, -t) for rank, (t, k) in enumerate(best, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>"


def hard(df, modulus, **kw):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % modulus == 0, **kw).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_are_exact(spark, monkeypatch, small):
    """Ties by the hundred, copies, repeated ids, nulls; with small digits and blocks every window is refined over scores and ids."""
    if small:
        for name, value in {"CANDIDATES": 50, "ANCHORS": 4, "BUCKETS": 4, "FEW": 1}.items():
            monkeypatch.setattr(negatives, name, value)
    r = random.Random(8)
    rows = [(i, r.randrange(3), [r.randrange(-2, 5) / 4 for _ in range(4)]) for i in range(260)]
    rows += [(300 + i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(150)] + [(20, 1, [1.0, 1.0, 0.0, 0.0]), (20, 2, [1.0, 1.0, 0.0, 0.0]), (40, 0, [0.25] * 4)] * 2
    rows += [(600, 1, None), (620, None, [1.0] * 4), (640, 1, [1.0, None]), (660, 1, [float("nan")] * 4), (680, 1, [float("inf")]), (None, 1, [1.0] * 4), (700, 2, [1.0]), (720, 1, []), (740, 9, [1.0] * 4), (-20, 1, [0.75, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("score", "block", "rank", "asked", "v")})
    assert hard(df, 20) == mined(rows, lambda i: i % 20 == 0)


def test_hard_negatives_of_large_components(spark):
    """Scores beyond 2^53, beyond 2^62 and beyond what a long or a double holds."""
    r = random.Random(9)
    for scale in (3e5, 1e7, 1e12):
        rows = [(i, i % 2, [r.gauss(0, scale) for _ in range(3)]) for i in range(60)]
        assert hard(spark.createDataFrame(rows, VECTORS), 10) == mined(rows, lambda i: i % 10 == 0)
    rows = [(i, i % 2, [1.7e308 if i % 3 else -1.0, 1.0]) for i in range(30)]
    assert len(hard(spark.createDataFrame(rows, VECTORS), 10)) == 50 + 20  # anchors 10 and 20 have five positives, anchor 0 has the four others like it


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], VECTORS)
    assert hard(empty, 10) == [] == hard(one, 10) == hard(one, 7, k_positive=1)


def whitened_by_hand(rows, k=16):
    ok = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(x) for _, x in ok)
    ok = [(i, x + [1_000_000] * (d - len(x))) for i, x in ok]
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda x: np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
    rows = np.stack([centre(x) for x in fit])
    values, axes = np.linalg.eigh(rows.T @ rows / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), centre(x) @ axes / np.sqrt(values)) for i, x in ok], values / np.trace(rows.T @ rows / n)


def test_whitening(spark):
    r = np.random.default_rng(5)
    mix = r.normal(size=(20, 20)) * np.geomspace(2, 0.2, 20)
    rows = [(i, (mix @ r.normal(size=20)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(7, rows[3][1]), (7, rows[3][1]), (2000, [1.0, -1.0]), (None, rows[5][1])]
    bad = [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 20), (3003, [float("-inf")] * 20)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(3) for c in ("x", "n", "row", "component")}).repartition(5)
    n, wanted, explained = whitened_by_hand(rows)
    found = whitening.whiten(df).collect()
    assert len(found) == 16 * len(rows) and {x.n for x in found} == {n} and len({x.identity_error for x in found}) == 1 and 0 <= found[0].identity_error < 1e-9
    got = {}
    for x in found:
        got.setdefault((-1 if x.vec_id is None else x.vec_id, x.deviation), {}).setdefault(x.component, []).append(x.whitened)
        assert abs(x.explained / explained[x.component - 1] - 1) < 1e-9
    signs = np.sign([got[0, wanted[0][1]][c][0] * wanted[0][2][c - 1] for c in range(1, 17)])
    for i, deviation, row in wanted:
        mine = got[-1 if i is None else i, deviation]
        assert all(np.allclose(mine[c], signs[c - 1] * row[c - 1], atol=1e-8) for c in range(1, 17))


def test_whitening_of_few_dimensions_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(x.vec_id, x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one} == {(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], schema)).collect()
    assert {x.whitened for x in flat if x.component == 2} == {0.0} and {x.explained for x in flat} == {1.0, 0.0} and max(x.identity_error for x in flat) < 1e-12
    assert np.isclose(sum(x.whitened**2 for x in flat if x.component == 1) / 4, 1)


def test_whitening_of_large_components(spark):
    """Entries, sums and deviations that longs do not hold: deviations are saturated, directions stay."""
    rows = [(i, [1e15 * i, float(i % 3)]) for i in range(12)] + [(20, [1e300, 0.0]), (21, [-1e300, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 2 * len(rows) and {x.deviation for x in found if x.vec_id >= 20} == {(1 << 63) - 1} and found[0].identity_error < 1e-6
    rows = rows[:12]
    n, wanted, _ = whitened_by_hand(rows, 1)
    found = {x.vec_id: x for x in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()}
    assert all(min(deviation, (1 << 63) - 1) == found[i].deviation and np.isclose(abs(found[i].whitened), abs(row[0])) for i, deviation, row in wanted)
