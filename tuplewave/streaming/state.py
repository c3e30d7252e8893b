"""The live tuples of an engine, as tables in the session's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Batches after which the tables are merged and tuples whose life has ended are left out.
COMPACT_AFTER = 16


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the session's shared one; only a session on this machine alone may lack that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tuplewave")
    return f"{base.rstrip('/')}/{name}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class TupleStore:
    """``after`` is the cleanup policy: a number of batches, or a function of the batches and tuples kept since the last
    cleanup that says whether it is time for one."""

    def __init__(self, spark: SparkSession, columns: tuple[str, ...], after: int | Callable[[int, int], bool] = COMPACT_AFTER) -> None:
        self.spark, self.columns, self.seq = spark, columns, 0
        self.parts: list[str] = []
        self.made: set[str] = set()
        self.fresh = 0
        self.due = after if callable(after) else lambda batches, tuples: batches > after
        self.root = shared_folder(spark, "tuplewave-state")
        self.schema = ", ".join(f"`{c}` string" for c in columns) + ", seq long, arrival timestamp, expires_at timestamp"

    def write(self, df: DataFrame) -> str:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def append(self, df: DataFrame, now: float, end: float | None, batch: str | None = None) -> int:
        """Number the tuples of a micro-batch and keep them; returns how many there are.

        A batch whose name was taken before is not taken again. A small batch with ``nth`` keeps its order by a window
        over that one batch; else tuples are numbered as they lie.
        """
        if batch is not None and batch in self.made:
            return 0
        stamp = lambda t: F.timestamp_micros(F.lit(round(t * 1e6))) if t is not None else F.lit(None).cast("timestamp")
        nth = F.row_number().over(W.orderBy("nth")) if "nth" in df.columns else F.monotonically_increasing_id() + 1
        rows = df.select(*self.columns, (nth + self.seq).cast("long").alias("seq"), stamp(now).alias("arrival"), stamp(end).alias("expires_at"))
        path = self.write(rows)
        got = self.spark.read.schema(self.schema).parquet(path).agg(F.count(F.lit(1)), F.max("seq")).head()
        if batch is not None:
            self.made.add(batch)
        if not got[0]:
            self.delete(path)
            return 0
        self.parts.append(path)
        self.seq = got[1]
        self.fresh += got[0]
        if self.due(len(self.parts), self.fresh):
            self.rewrite(lambda live: live.where(F.col("expires_at").isNull() | (F.col("expires_at") >= stamp(now))))
        return got[0]

    def all(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.parts)

    def live(self, now: float, since: int = -1) -> DataFrame:
        """Tuples that arrived after ``since`` and are alive."""
        alive = F.col("expires_at").isNull() | (F.col("expires_at") >= F.timestamp_micros(F.lit(round(now * 1e6))))
        return self.all().where(alive & (F.col("seq") > since))

    def since(self, seq: int) -> DataFrame:
        return self.all().where(F.col("seq") > seq)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Replace the tables by what ``change`` leaves; true if that is less. The old ones are deleted."""
        before = self.all().count()
        self.fresh = 0
        if not before:
            return False
        path = self.write(change(self.all()).select(*self.columns, "seq", "arrival", "expires_at"))
        old, self.parts = self.parts, [path]
        for part in old:
            self.delete(part)
        return self.all().count() < before

    def clear(self) -> None:
        self.parts, self.seq, self.fresh = [], 0, 0
        self.made.clear()
        self.delete(self.root)
