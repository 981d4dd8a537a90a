"""Session helpers: sensible defaults that never override a cluster's own settings."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults applied only where the session does not set the key already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "lexspark", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one (local runs and tests)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("LEXSPARK_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  Only a local-mode session
    without it gets a fresh temporary folder (tests); a cluster must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) on a cluster")
        configured = tempfile.mkdtemp(prefix="lexspark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def package_zip(folder: str) -> str:
    """A zip of this package in ``folder``, for ``--py-files`` or ``ship``."""
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(folder, "lexspark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(path, name)
                z.write(full, os.path.relpath(full, os.path.dirname(package)))
    return target


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a running session, whose Python functions import it."""
    spark.sparkContext.addPyFile(package_zip(tempfile.mkdtemp(prefix="lexspark-zip-")))


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_scopes = threading.local()  # a stack of lists of paths per thread


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are deleted at the end: for work that repeats (the batches of
    a stream) and whose result is written elsewhere by then."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete_path(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append(path)
    return path


def materialize(df, name: str):
    """Write ``df`` once as Parquet in the shared folder and read it back: later
    actions reuse the rows instead of recomputing the plan, and the rows survive
    the loss of an executor (unlike a cache)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
