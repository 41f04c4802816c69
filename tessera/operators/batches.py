"""Document batches: specifications in, documents or reasons out; one bad row never stops the others."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Transient(Exception):
    """A failure that may pass by itself."""


@dataclass(frozen=True)
class Retry:
    """Exponential back-off with jitter, for transient failures only."""

    attempts: int = 3
    base: float = 0.05
    most: float = 2.0

    def run(self, fn: Callable, *args, sleep: Callable[[float], None] = time.sleep):
        for k in range(1, self.attempts + 1):
            try:
                return fn(*args), k
            except Transient:
                if k == self.attempts:
                    raise
                sleep(min(self.most, self.base * 2 ** (k - 1)) * random.Random(k).uniform(0.5, 1.0))


def content_id(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:24]


SCHEMA = "content_id string, status string, stage string, error string, attempts int, document string"


def run(specs: DataFrame, validate: Callable[[dict], list[str]], generate: Callable[[dict], dict], check: Callable[[dict], list[str]], done: DataFrame | None = None, column: str = "spec", retry: Retry = Retry()) -> DataFrame:
    """One row per distinct specification (JSON text): status ``ok`` or ``failed``, with stage and reason.

    Specifications whose id is in ``done`` are left out, so that a batch can be run again.
    """
    distinct = specs.select(F.col(column).alias("spec")).where("spec is not null").distinct()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for raw in frame["spec"]:
                stage, attempts = "validate", 1
                cid = hashlib.sha256(raw.encode()).hexdigest()[:24]
                try:
                    spec = json.loads(raw)
                    cid = content_id(spec)
                    if problems := validate(spec):
                        raise ValueError("; ".join(problems))
                    stage = "generate"
                    doc, attempts = retry.run(generate, spec)
                    stage = "check"
                    if problems := check(doc):
                        raise ValueError("; ".join(problems))
                    rows.append((cid, "ok", "done", None, attempts, json.dumps(doc, sort_keys=True, ensure_ascii=False)))
                except Exception as why:  # noqa: BLE001 - a row's failure is its result
                    rows.append((cid, "failed", stage, f"{type(why).__name__}: {why}"[:300], attempts, None))
            yield pd.DataFrame(rows, columns=["content_id", "status", "stage", "error", "attempts", "document"])

    out = distinct.mapInPandas(work, SCHEMA).dropDuplicates(["content_id"])
    return out if done is None else out.join(done.select("content_id"), "content_id", "left_anti")


def tally(results: DataFrame) -> DataFrame:
    """status, stage, documents."""
    return results.groupBy("status", "stage").agg(F.count(F.lit(1)).alias("documents"))
