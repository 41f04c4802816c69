"""Chunked generation, hashed parts and background jobs: hashes for any partitioning, aborts, progress, cancelling."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import jobs
from tessera.operators import generate
from tessera.sources import chunked

SCHEMA = "row_text string, x double, k long, t timestamp, ok boolean"


def numbered(spark, n):
    text = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, F.lit("")).otherwise(F.concat(F.lit('a "q", é\n'), F.col("id")))
    return spark.range(n).select(F.col("id").alias("row"), text.alias("row_text"), (F.col("id") / 3).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") * 7).alias("k"), F.timestamp_seconds(F.col("id") * 1_000).alias("t"), (F.col("id") % 2 == 0).alias("ok"))


def files(path):
    return sorted(f.name for f in Path(path.removeprefix("file://")).iterdir() if f.name.startswith("part"))


@pytest.mark.parametrize("fmt", ["csv", "jsonl"])
def test_parts_round_trip_with_equal_hashes(spark, tmp_path, fmt):
    df, hashes = numbered(spark, 1_050), set()
    for n in (1, 3, 8):
        path = f"file://{tmp_path}/{fmt}-{n}"
        chunked.written_parts(df.repartition(n), path, 200, fmt, partitions=n)
        parts = chunked.listed(path)
        assert [(p.chunk, p.rows) for p in parts] == [(i, 200) for i in range(5)] + [(5, 50)] and files(path) == sorted(p.file for p in parts)
        hashes.add(chunked.total(parts))
    assert len(hashes) == 1
    back = chunked.registered(spark).read.format("hashed_parts").schema(SCHEMA).option("path", path).option("format", fmt).load()
    wanted = df.drop("row")
    if fmt == "jsonl":
        back, wanted = (x.drop("t") for x in (back, wanted))  # times are text there
    assert back.count() == 1_050 and back.exceptAll(wanted).count() == 0 == wanted.exceptAll(back).count()


def test_aborted_and_changed_parts(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    chunked.written_parts(numbered(spark, 400), path, 100)
    before = files(path), chunked.listed(path)
    broken = numbered(spark, 900).where("row >= 400").withColumn("x", F.when(F.col("row") == 850, F.raise_error(F.lit("broken row"))).otherwise(F.col("x")).cast("double"))
    with pytest.raises(Exception, match="broken row"):
        chunked.written_parts(broken, path, 100, append=True)
    assert (files(path), chunked.listed(path)) == before
    chunked.written_parts(numbered(spark, 900).where("row >= 400"), path, 100, append=True)
    assert [p.chunk for p in chunked.listed(path)] == list(range(9))
    with pytest.raises(Exception, match="already"):
        chunked.written_parts(numbered(spark, 100), path, 100, append=True)
    assert len(files(path)) == 9
    chunked.written_parts(numbered(spark, 300), path, 100)
    assert len(files(path)) == 3 == len(chunked.listed(path))
    part = Path(path.removeprefix("file://")) / files(path)[0]
    part.write_bytes(part.read_bytes().replace(b"33", b"34"))
    with pytest.raises(Exception, match="not what was written"):
        chunked.registered(spark).read.format("hashed_parts").schema(SCHEMA).option("path", path).load().count()


def test_chunks_depend_on_seed_and_number_alone(spark):
    model = generate.from_spec([{"name": "a", "mean": 5.0, "std": 2.0}, {"name": "b", "values": ["x", "y"]}])
    whole = chunked.generated(spark, model, 1_000, 250, seed=3)
    pieces = chunked.generated(spark, model, 1_000, 250, seed=3, last=2).unionByName(chunked.generated(spark, model, 1_000, 250, seed=3, first=2))
    assert whole.count() == 1_000 == whole.select("row").distinct().count() and whole.exceptAll(pieces).count() == 0
    assert chunked.plan(1_001, 250)[-1] == (1_000, 1) and len({chunked.chunk_seed(1, i) for i in range(500)}) == 500
    for bad in ((0, 100), (10, 99), (chunked.MOST_ROWS + 1, 1_000)):
        with pytest.raises(ValueError):
            chunked.plan(*bad)


@pytest.fixture
def source(spark, tmp_path):
    spark.range(500).select((F.col("id") % 40 + F.col("id") / 100).alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c")).write.parquet(f"{tmp_path}/source")
    return f"{tmp_path}/source"


def test_large_jobs_report_progress_and_reproduce(spark, tmp_path, source):
    store = jobs.Store(str(tmp_path / "jobs"))
    seen = []
    job = jobs.background(spark, store, "large", {"source": source, "rows": 1_200, "chunk_rows": 200, "wave": 2, "seed": 4})
    while job.thread.is_alive():
        seen.append(job.manifest["progress"]["done"])
        time.sleep(0.1)
    done = job.wait()
    assert done["state"] == "done" and done["rows"] == 1_200 and done["chunks"] == 6 and done["progress"] == {"done": 1_200, "total": 1_200, "phase": "generate", "seconds_left": 0.0}
    assert seen == sorted(seen) and 0 < len(set(seen)) <= 4
    other = jobs.submit(spark, store, "large", {"source": source, "rows": 1_200, "chunk_rows": 200, "wave": 6, "seed": 4})
    assert other["state"] == "done" and other["output_hash"] == done["output_hash"]


def test_cancelled_jobs_keep_what_was_committed(spark, tmp_path, source):
    store = jobs.Store(str(tmp_path / "jobs"))
    job = jobs.background(spark, store, "large", {"source": source, "rows": 1_000_000, "chunk_rows": 1_000, "wave": 2, "seed": 4})
    while job.thread.is_alive() and job.manifest["progress"]["done"] < 4_000:
        time.sleep(0.05)
    assert job.tasks().keys() == {"total", "done"}
    job.cancel()
    done = job.wait(120)
    assert done["state"] == "cancelled" and 4_000 <= done["rows"] < 1_000_000 and done["rows"] == 1_000 * done["chunks"]
    parts = chunked.listed(done["path"])
    assert [p.chunk for p in parts] == list(range(done["chunks"])) and files(done["path"]) == sorted(p.file for p in parts)
    back = chunked.registered(spark).read.format("hashed_parts").schema("v double, c string").option("path", done["path"]).load()
    assert back.count() == done["rows"]


def test_failed_and_lost_jobs(spark, tmp_path):
    store = jobs.Store(str(tmp_path / "jobs"))
    job = jobs.background(spark, store, "large", {"source": f"{tmp_path}/nowhere", "rows": 1_000})
    assert job.wait()["state"] == "failed" and "nowhere" in job.wait()["error"]
    slept = jobs.Background(spark, store, "check", {}, lambda progress, stopped: (time.sleep(0.3), progress(1, 1, "slept"), {"report": []})[2])
    assert store.read(slept.id)["state"] == "running" and slept.wait()["state"] == "done"
    store.save("0-lost", {"id": "0-lost", "kind": "check", "params": {}, "state": "running"})
    assert jobs.recovered(store) == ["0-lost"] and store.read("0-lost")["state"] == "failed"
