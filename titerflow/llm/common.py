"""Small helpers shared by the corpus operators: tables, written intermediates, document keys, Arrow access."""
from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.session import materialize

#: Marks an assigned key column; inputs may have columns of any other name.
ID, SUB = "_llm_id", "_llm_sub"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and go on from the files: lineage ends there.

    Shuffle files of a finished job are of no further use then, so Spark is told to remove them as it goes.
    """
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return materialize(df)


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``_llm_id`` and ``_llm_sub``, which tell documents apart even where an id repeats.

    ``_llm_sub`` is 0 when no id repeats (the usual case, and it then costs nothing in a shuffle), else a hash
    of the text.  Rows equal in both are the same document.
    """
    repeats = df.groupBy(id_col).count().where("count > 1").limit(1).count() > 0
    sub = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(1)) if repeats else F.lit(0).cast("bigint")
    return df.withColumns({ID: F.col(id_col).cast("bigint"), SUB: sub})


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns of two frames."""
    out = None
    for n in names:
        one = a[n].eqNullSafe(b[n])
        out = one if out is None else out & one
    return out


def views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each value of an Arrow string column, without a copy; None for null."""
    if len(column) == 0:
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield None if missing[k] else raw[at[k] : at[k + 1]]


def arrow_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one array per row."""
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of the Arrow batches, so that what a task builds from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_shipped: set[str] = set()


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` after sending this package to the executors, once per application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = pathlib.Path(__file__).resolve().parent.parent
        target = pathlib.Path(tempfile.mkdtemp()) / f"{package.name}_code.zip"
        with zipfile.ZipFile(target, "w") as bundle:
            for path in sorted(package.rglob("*.py")):
                bundle.write(path, path.relative_to(package.parent).as_posix())
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return df.mapInArrow(work, schema)
