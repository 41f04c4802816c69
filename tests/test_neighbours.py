"""The index of pivots and rings against brute force."""

import math
import random

import pytest

from tessera.operators import neighbours


def brute(queries, rows):
    out = {}
    for i, v in queries:
        best = min(((math.dist(v, w), j) for j, w in rows if j != i), default=None)
        if best:
            out[i] = best
    return out


@pytest.mark.parametrize("size", [7, 64])
def test_clusters_copies_and_repeated_ids(spark, size):
    r = random.Random(2)
    centres = [[r.gauss(0, 30) for _ in range(3)] for _ in range(15)]
    rows = [(i, [c + r.gauss(0, 0.3) for c in centres[i % 15]]) for i in range(500)]
    rows += [(1_000 + i, centres[3]) for i in range(250)] + [(5, centres[4]), (5, centres[5]), (2_000, [1e6, 1e6, 1e6]), (2_001, [1e6, 1e6, 1e6 + 1e-3])]
    odd = [(None, [0.0] * 3), (3_000, None), (3_001, [0.0, None, 0.0]), (3_002, [math.nan] * 3), (3_003, [math.inf] * 3)]
    df = spark.createDataFrame(rows + odd, "k long, v array<double>").repartition(5)
    index = neighbours.Index.build(df, "k", "v", size=size)
    found, seen = index.search(df, "k", "v")
    single = [(i, v) for i, v in rows if i != 5]
    wanted = brute(single, rows)
    got = {x.id: (x.distance, x.near, x.single) for x in found.collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, (d, j) in wanted.items():
        assert got[i][0] == pytest.approx(d, abs=1e-9) and min(math.dist(dict(single)[i], w) for k, w in rows if k == got[i][1]) == pytest.approx(d, abs=1e-9)
    assert got[1_000][2] is False and got[2_000] == (pytest.approx(1e-3, rel=1e-3), 2_001, True)
    assert got[5][0] == pytest.approx(min(brute([(5, v)], rows)[5][0] for i, v in rows if i == 5))
    assert seen["compared"] < 0.6 * seen["pairs"]


def test_other_queries_than_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.random(), r.random()]) for i in range(400)]
    queries = [(10_000 + i, [r.random() * 3, r.random()]) for i in range(300)] + [(7, rows[7][1])]
    make = lambda x: spark.createDataFrame(x, "k long, v array<float>")
    rows, queries = ([(x.k, list(x.v)) for x in make(t).collect()] for t in (rows, queries))
    got = {x.id: x.distance for x in neighbours.nearest(make(queries), make(rows), "k", "v", block=16).collect()}
    assert got == pytest.approx({i: d for i, (d, _) in brute(queries, rows).items()})
    one = spark.createDataFrame([(1, [2.0])], "k long, v array<double>")
    assert neighbours.nearest(one, one, "k", "v").count() == 0
    with pytest.raises(Exception, match="different lengths"):
        neighbours.nearest(make(queries), one, "k", "v").count()


def test_blocks_meet_by_name(spark, monkeypatch):
    """What is shuffled are names of stored blocks: no vectors, however many pairs of blocks there are."""
    monkeypatch.setattr(neighbours, "MET", 3)
    r = random.Random(4)
    rows = [(i, [r.random() for _ in range(12)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    index = neighbours.Index.build(df, "k", "v", size=20)
    assert {t for _, t in index.blocks.dtypes} == {"bigint", "int", "double", "string"}
    found, seen = index.search(df, "k", "v")
    assert seen["compared"] > 3 * index.blocks.count()
    assert {x.id: (pytest.approx(x.distance), x.near) for x in found.collect()} == brute(rows, rows)


def test_bounds_are_found_in_many_tasks(spark, monkeypatch, tmp_path):
    """Blocks of queries are few rows: they are dealt by number, not left to a task by their bytes."""
    inner = neighbours.reaching

    def marked(pivots, folder):
        run = inner(pivots, folder)

        def noted(batches):
            from pyspark import TaskContext

            held = [b for b in batches if b.num_rows]
            if held:
                (tmp_path / str(TaskContext.get().partitionId())).touch()
            yield from run(iter(held))

        return noted

    monkeypatch.setattr(neighbours, "reaching", marked)
    r = random.Random(7)
    df = spark.createDataFrame([(i, [r.random(), r.random()]) for i in range(400)], "k long, v array<double>")
    assert neighbours.Index.build(df, "k", "v", size=10).nearest(df, "k", "v").count() == 400
    assert len(list(tmp_path.iterdir())) > 2
