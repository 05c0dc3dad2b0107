"""Session settings, checkpoint folder and pinned intermediate frames."""
from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_pinned: list[DataFrame] = []
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def build_session(app: str = "titerflow", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; any setting can be overridden by keyword (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder iterative jobs cut their lineage into.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local master may fall back to
    a temporary folder, because there every task sees the same disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="titerflow-ckpt-")
    context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table below the checkpoint folder and continue from the files.

    Used where several branches of a plan must see the same rows (or the same partition cuts).  Lineage is
    cut, a lost executor costs nothing that was written, and the file sizes tell Catalyst what is small
    enough to broadcast.
    """
    spark = df.sparkSession
    path = temp_table_path(spark, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(make())``, without what it needed on the way: tables written by ``make`` are deleted, and shuffle
    files go at the end of each of its jobs."""
    key, mark = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", len(_written)
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        out = materialize(make())
    finally:
        spark.conf.set(key, before)
    own = _written.pop()
    while len(_written) > mark:
        _delete(*_written.pop())
    _written.append(own)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows over the cores when the input has fewer splits than cores, by the hash of ``keys``.

    A few large row groups would otherwise keep all expression work in a few tasks.  A large input has more
    splits than cores and is returned as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for functions that run inside tasks."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp()) / f"{package.name}_package.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted(package.rglob("*.py")):
            bundle.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def pin(df: DataFrame) -> DataFrame:
    """Cache a feature table for iterative training; lost blocks are recomputed from lineage."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _pinned.append(kept)
    return kept


def release() -> None:
    """Drop cached frames and everything written below ``temp_table_path``, such as ``materialize`` tables.

    Call it after the results that use them are written: frames built on them cannot be read afterwards.
    """
    while _pinned:
        _pinned.pop().unpersist()
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def temp_table_path(spark: SparkSession, name: str) -> str:
    """A path below the checkpoint folder for a table shared by several jobs; ``release`` deletes it."""
    path = os.path.join(checkpoint_dir(spark), name)
    _written.append((spark, path))
    return path
