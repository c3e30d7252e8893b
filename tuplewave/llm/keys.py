"""A key for each row, so that what is found for a text can be joined back to its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize


def free_name(columns: list[str], name: str) -> str:
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column without nulls or repeats: the id itself if it is one, else an added one.

    The added key is written with the rows, since it would change if a lost task numbered them again.
    """
    ids = docs.groupBy(F.col(id_col).alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null")
    if not ids.head(1):
        return docs, id_col
    key = free_name(docs.columns, "row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """``schema`` and one more field, whose type is written as in SQL."""
    return StructType([*schema.fields, StructType.fromDDL(f"`{name}` {kind}")[0]])
