"""Shared folders, column plumbing and array helpers of the pipeline operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; where it is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        found = _own[application]
    if "://" not in found:  # as Spark reads it: a path of the default file system
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        found = default.rstrip("/") + found if not default.startswith("file:") else found
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor, so later stages restart from them.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads; extra columns of any name never reach it."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have, upper or lower case alike."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the ids as longs, null texts as empty ones."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


#: What each operator keeps in a Python worker between tasks, and how to drop it.
KEPT: dict[str, Callable[[], None]] = {}
_worker: dict = {"operator": None, "libc": None}


def entered(operator: str) -> None:
    """Called in a Python worker before a partition of ``operator``.

    Workers outlive tasks and serve one operator after another; what other operators keep is dropped,
    and large blocks go back to the system when they are freed.
    """
    if _worker["libc"] is None:
        try:
            _worker["libc"] = ctypes.CDLL("libc.so.6")
            _worker["libc"].mallopt(-3, 1 << 20)  # blocks of a megabyte and more are mapped on their own
        except (OSError, AttributeError):
            _worker["libc"] = False
        pa.set_memory_pool(pa.system_memory_pool())
    if _worker["operator"] not in (None, operator):
        for name, drop in KEPT.items():
            if name != operator:
                drop()
    _worker["operator"] = operator


def left() -> None:
    """Called in a Python worker after a partition: what is free goes back to the system."""
    if _worker["libc"]:
        try:
            _worker["libc"].malloc_trim(0)
        except AttributeError:
            _worker["libc"] = False


def worker(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable:
    """``run`` between ``entered`` and ``left``."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(operator)
        try:
            yield from run(batches)
        finally:
            left()

    return wrapped


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, operator: str = "batch") -> DataFrame:
    """Apply ``fn`` to Arrow batches, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(worker(operator, run), schema)


def slices(column: pa.Array, budget: int = 2_000_000, rows: int = 512) -> Iterator[list]:
    """Parts of a text column as lists, each of about ``budget`` bytes and at most ``rows`` rows, so that
    the texts of a batch are never all Python objects at once."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= budget or i + 1 - start >= rows:
            yield column.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    if start < len(lengths):
        yield column.slice(start).to_pylist()
