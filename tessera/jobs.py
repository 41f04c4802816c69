"""Jobs with manifests: run, rerun, compare, in the background with progress and cancelling, and a command line.

A background job runs in a thread whose Spark jobs carry the job's tag and group: the status tracker tells how many of
their tasks are done, and cancelling stops them all. A large job generates its chunks in waves, each a Spark job that
commits its parts; a cancelled job keeps the waves that were committed, and its manifest says how many rows these are.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import InheritableThread

from tessera.sources.sinks import canonical


class Store:
    """A folder with one JSON manifest and the artifacts of each job."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def path(self, job: str, name: str = "manifest.json") -> Path:
        found = (self.folder / job / name).resolve()
        if not found.is_relative_to((self.folder / job).resolve()):
            raise ValueError("the name leaves the job's folder")
        return found

    def save(self, job: str, manifest: dict) -> None:
        path = self.path(job)
        path.parent.mkdir(parents=True, exist_ok=True)
        own = path.with_name(f".{uuid.uuid4().hex}")
        own.write_text(json.dumps(manifest, indent=1, ensure_ascii=False, default=str), encoding="utf-8")
        own.replace(path)

    def read(self, job: str) -> dict:
        return json.loads(self.path(job).read_text(encoding="utf-8"))

    def list(self, kind: str | None = None, limit: int = 50) -> list[dict]:
        """Newest first."""
        found = [json.loads(p.read_text(encoding="utf-8")) for p in self.folder.glob("*/manifest.json")]
        found = [m for m in found if kind is None or m["kind"] == kind]
        return sorted(found, key=lambda m: m["id"], reverse=True)[: min(limit, 500)]


#: Seconds between two writes of a job's progress.
EVERY = 0.4
#: States that a job does not leave.
ENDED = ("done", "failed", "cancelled")

KINDS = {"large": {"source", "columns", "rows", "chunk_rows", "wave", "seed", "format", "path"}, "dataset": {"name", "rows", "seed", "format"}, "request": {"text", "seed", "format"}, "check": {"sf_dir", "rules"}}


def validated(kind: str, params: dict) -> dict:
    if kind not in KINDS:
        raise ValueError(f"unknown job {kind}")
    if extra := params.keys() - KINDS[kind]:
        raise ValueError(f"unknown parameters {', '.join(sorted(extra))}")
    return params


class Cancelled(Exception):
    """Raised inside a job that was asked to stop; ``made`` is what it has committed."""

    def __init__(self, made: dict):
        super().__init__("cancelled")
        self.made = made


class Background:
    """A job in a thread of its own. ``act(progress, stopped)`` does the work: it calls ``progress(done, total, phase)`` and looks at ``stopped()``."""

    def __init__(self, spark, store: Store, kind: str, params: dict, act: Callable[[Callable[[int, int | None, str], None], Callable[[], bool]], dict]):
        self.spark, self.store, self.act = spark, store, act
        self.id = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:6]}"
        self.tag = f"tessera-{self.id}"
        self.manifest = {"id": self.id, "kind": kind, "params": params, "parent": None, "state": "running", "files": [], "progress": {"done": 0, "total": None, "phase": "queued"}}
        self._stop, self._lock, self._last = threading.Event(), threading.Lock(), 0.0
        store.save(self.id, self.manifest)
        self.thread = InheritableThread(target=self._run, name=self.tag, daemon=True)
        self.thread.start()

    def _save(self, **changes) -> None:
        with self._lock:
            self.manifest |= changes
            self.store.save(self.id, self.manifest)

    def progressed(self, done: int, total: int | None, phase: str) -> None:
        """Kept at once; written at most every ``EVERY`` seconds, and at the end of a phase."""
        now = time.monotonic()
        rate = done / max(now - self._began, 1e-9)
        self.manifest["progress"] = {"done": done, "total": total, "phase": phase, "seconds_left": None if not total or not done else round((total - done) / rate, 1)}
        if now - self._last >= EVERY or done == total:
            self._last = now
            self._save()

    def _run(self) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(self.tag, self.tag, interruptOnCancel=True)
        context.addJobTag(self.tag)
        self.spark.createDataFrame([(0,)], "x int")  # makes the session this thread's active one, in which writers look up data sources
        self._began = time.monotonic()
        try:
            self._save(**self.act(self.progressed, self._stop.is_set), state="done")
        except Cancelled as why:
            self._save(**why.made, state="cancelled")
        except Exception as why:  # noqa: BLE001 - the manifest is where failures are told
            self._save(state="cancelled" if self._stop.is_set() else "failed", error=f"{type(why).__name__}: {why}"[:500])

    def tasks(self) -> dict[str, int]:
        """Tasks of the job's Spark stages that are running now: how many there are and how many are done."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(self.tag) if (info := tracker.getJobInfo(j)) and info.status == "RUNNING" for s in info.stageIds}
        found = [i for s in stages if (i := tracker.getStageInfo(s))]
        return {"total": sum(i.numTasks for i in found), "done": sum(i.numCompletedTasks for i in found)}

    def cancel(self) -> None:
        """Ask the job to stop, and stop its Spark jobs; what is committed stays."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> dict:
        self.thread.join(seconds)
        return self.store.read(self.id)


def large(spark, params: dict, path: str) -> Callable:
    """The work of a large job: fit ``source`` (a Parquet path), then generate and commit chunks, ``wave`` at a time and in order."""
    from tessera.operators import generate
    from tessera.sources import chunked

    rows, chunk_rows, seed, fmt, wave = params["rows"], params.get("chunk_rows", 100_000), params.get("seed", 0), params.get("format", "csv"), params.get("wave", 64)
    chunks = chunked.plan(rows, chunk_rows)

    def made() -> dict:
        parts = chunked.listed(path)
        return {"rows": sum(p.rows for p in parts), "chunks": len(parts), "bytes": sum(p.bytes for p in parts), "output_hash": chunked.total(parts), "path": path}

    def act(progress, stopped) -> dict:
        df = spark.read.parquet(params["source"])
        progress(0, rows, "fit")
        model = generate.fit(df.select(*params["columns"]) if params.get("columns") else df)
        for at in range(0, len(chunks), wave):
            if stopped():
                raise Cancelled(made())
            end = min(at + wave, len(chunks))
            try:
                chunked.written_parts(chunked.generated(spark, model, rows, chunk_rows, seed, at, end), path, chunk_rows, fmt, append=at > 0, partitions=end - at)
            except Exception as why:
                if stopped():
                    raise Cancelled(made()) from why
                raise
            progress(sum(n for _, n in chunks[:end]), rows, "generate")
        return made()

    return act


def background(spark, store: Store, kind: str, params: dict) -> Background:
    """Start a job and return at once. Jobs that do not commit in waves end only as a whole; cancelled, they keep nothing."""
    params = validated(kind, params)
    if kind == "large":
        path = params.get("path") or f"file://{store.folder.resolve()}/parts-{uuid.uuid4().hex}"
        return Background(spark, store, kind, params, large(spark, params, path))
    return Background(spark, store, kind, params, lambda progress, stopped: _run(spark, store, f"run-{uuid.uuid4().hex[:12]}", kind, params))


def recovered(store: Store) -> list[str]:
    """Jobs that an ended process left as running become failed; their ids."""
    lost = [m for m in store.list(limit=500) if m["state"] == "running"]
    for m in lost:
        store.save(m["id"], m | {"state": "failed", "error": "the process that ran it has ended"})
    return [m["id"] for m in lost]


def submit(spark, store: Store, kind: str, params: dict, parent: str | None = None) -> dict:
    """Run a job now; failures are recorded, not raised."""
    params = validated(kind, params)
    job = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:6]}"
    manifest = {"id": job, "kind": kind, "params": params, "parent": parent, "state": "running", "files": []}
    store.save(job, manifest)
    try:
        manifest |= _run(spark, store, job, kind, params) | {"state": "done"}
    except Exception as why:  # noqa: BLE001 - the manifest is where failures are told
        manifest |= {"state": "failed", "error": f"{type(why).__name__}: {why}"[:500]}
    store.save(job, manifest)
    return manifest


def _run(spark, store: Store, job: str, kind: str, params: dict) -> dict:
    from tessera.language import requests
    from tessera.sources import datasets, sinks

    if kind == "large":
        path = params.get("path") or f"file://{store.path(job, 'parts')}"
        return large(spark, params, path)(lambda done, total, phase: None, lambda: False)
    if kind == "check":
        from tessera.operators.rules import plans
        from tessera.sources.tables import tpc, tpc_graph

        tables, graph = tpc(spark, params["sf_dir"]), tpc_graph()
        rows = [r.asDict() for r in plans.report(plans.compile_rules(params["rules"], tables, graph), tables, graph).collect()]
        return {"report": rows, "output_hash": hashlib.sha256(canonical(rows).encode()).hexdigest()}
    if kind == "dataset":
        tables = datasets.source(spark, params["name"], params.get("rows", 1_000), params.get("seed", 0))
    else:
        tables = requests.build(spark, requests.parse(params["text"], params.get("seed", 0)).config)
    files, fmt = [], params.get("format", "csv")
    for name, df in tables.items():
        ordered = df.orderBy(*[c for c, t in df.dtypes if not t.startswith(("array", "map"))])
        done = sinks.merged(sinks.exporter(fmt)({name: ordered}, None), str(store.path(job, f"{name}.{fmt}")))
        files.append({"name": f"{name}.{fmt}", "bytes": done.bytes, "sha256": done.sha256})
    return {"files": files, "output_hash": hashlib.sha256(canonical(sorted(f["sha256"] for f in files)).encode()).hexdigest()}


def saved(spark, store: Store, kind: str, params: dict, act) -> dict:
    """Keep an explicit action as a job: ``act()`` is called, and its result, or its failure, goes to a manifest
    that can be rerun like any other. What the action returns or raises is passed on."""
    params = validated(kind, params)
    job = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:6]}"
    manifest = {"id": job, "kind": kind, "params": params, "parent": None, "action": True, "files": []}
    try:
        result = act()
    except Exception as why:
        store.save(job, manifest | {"state": "failed", "error": f"{type(why).__name__}: {why}"[:500]})
        raise
    store.save(job, manifest | {"state": "done", "result_hash": hashlib.sha256(canonical(result).encode()).hexdigest()})
    return {"id": job, "result": result}


def rerun(spark, store: Store, job: str, **overrides) -> dict:
    """The job again; ``reproduced`` tells whether the output is the same."""
    old = store.read(job)
    new = submit(spark, store, old["kind"], old["params"] | overrides, parent=job)
    new["reproduced"] = new.get("output_hash") == old.get("output_hash")
    store.save(new["id"], new)
    return new


def load_env(path: str = ".env") -> dict[str, str]:
    """Settings of a file; the real environment wins."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            out[name.strip()] = os.environ.setdefault(name.strip(), value.strip().strip("'\""))
    return out


def main(argv: list[str] | None = None) -> int:
    """0: done and clean; 1: done, but rules are broken; 2: it failed."""
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--store", default="jobs")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate")
    g.add_argument("name")
    g.add_argument("--rows", type=int, default=1_000)
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--format", default="csv")
    c = sub.add_parser("check")
    c.add_argument("sf_dir")
    c.add_argument("rules", nargs="+")
    r = sub.add_parser("rerun")
    r.add_argument("job")
    sub.add_parser("list")
    a = p.parse_args(argv)
    store = Store(a.store)
    if a.command == "list":
        for m in store.list():
            print(m["id"], m["kind"], m["state"])
        return 0
    from tessera.session import session

    spark = session()
    if a.command == "generate":
        found = submit(spark, store, "dataset", {"name": a.name, "rows": a.rows, "seed": a.seed, "format": a.format})
    elif a.command == "check":
        found = submit(spark, store, "check", {"sf_dir": a.sf_dir, "rules": a.rules})
    else:
        found = rerun(spark, store, a.job)
    print(json.dumps({k: found.get(k) for k in ("id", "state", "error", "output_hash", "reproduced", "report")}))
    if found["state"] != "done":
        return 2
    return int(any(r["violations"] for r in found.get("report", [])))
