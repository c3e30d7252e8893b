"""Shared helpers: scratch tables in the cluster's shared folder, size-checked broadcasts, batch slicing."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: Java and RE2 regular expression of one word of the contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Sides with at most this many bytes may be broadcast.
BROADCAST_BYTES = 48 << 20

#: Bytes of an Arrow batch to Python at most: the JVM and the worker each hold a batch and its copies for every task.
BATCH_BYTES = 4 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; only a session on this machine alone gets a folder of its own if it has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tuplewave-scratch")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tuplewave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to ``BATCH_BYTES``; a lower one stays. Rows are never cut."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, whose executors have this package; each operator begins with it."""
    spark = df.sparkSession
    ship(spark)
    bound_batches(spark)
    return spark


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a finished write are dropped at once instead of at the driver's next collection."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at a table that outlives executors."""
    spark = ready(df)
    path = scratch_path(spark, name)
    with shuffle_cleanup(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if a count of rows and of the bytes of texts proves ``df`` small; larger sides are left to
    shuffled joins."""
    wide = [F.octet_length(f"`{f.name}`") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    nested = [F.octet_length(F.to_json(F.struct(f"`{f.name}`"))) for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")]
    width = sum((F.coalesce(c, F.lit(0)) for c in wide + nested), F.lit(8 * len(df.columns) + 16)).cast("long")
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).head()[0]
    return F.broadcast(df) if size <= limit else df


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, offsets, bytes) over runs of rows of about ``max_bytes``; null texts are empty."""
    array = batch.column(batch.schema.get_field_index(column))
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n, at = len(array), array.offset
    if not n:
        return
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        lo, hi = offsets[row], offsets[end]
        yield row, offsets[row : end + 1] - lo, data[lo:hi]
        row = end


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator, in place on unsigned 64-bit integers."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
