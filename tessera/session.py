"""Session factory. Cluster-sized settings are left to the caller; only semantics are fixed here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """Build or reuse a session. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SEMANTICS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder that ``spark.checkpoint.dir`` names.

    A local session without one gets a folder of its own; on a cluster, where executors and the driver do not
    share local disks, that is an error.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoints-"))


def shared_uri(spark: SparkSession, label: str) -> str:
    """A fresh folder below the checkpoints', as a URI that ``pyarrow.fs`` opens."""
    import pyarrow.fs as pafs

    checkpoints(spark)
    base = spark.sparkContext.getCheckpointDir()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base.removeprefix('file:')}"
    uri = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return uri
