"""A corpus pipeline over ``documents``: each stage works on all rows that the one before it kept.

Nulls, empty and repeated rows are handled as the stages' operators say; repeated ids are told apart by a key, so a
stage never drops a row for another row's finding. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewave.llm.common import broadcast_if_small, materialize, read_table
from tuplewave.llm.decontaminate import leaks
from tuplewave.llm.keys import free_name, keyed
from tuplewave.llm.near_duplicates import near_duplicates as near_classes
from tuplewave.llm.packing import pack
from tuplewave.llm.quality_lm import verdicts
from tuplewave.llm.substring_dedup import substring_dedup

#: Near duplicates: shingles of five words, of which texts have a Jaccard similarity of at least 0.8.
SHINGLE, SIMILARITY = 5, 0.8


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def _without(rows: DataFrame, key: str, bad: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``rows`` but for those whose key is in the one column of ``bad``."""
    other = free_name(rows.columns, "bad")
    gone = broadcast_if_small(materialize(bad.toDF(other), name))
    return _columns(rows.join(gone, F.col(f"`{key}`") == F.col(other), "left_anti"), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of the trusted ones accepts."""
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows, key = keyed(docs, "doc_id")
    return _without(rows, key, verdicts(rows, trusted, key).where("not kept").select(key), docs, "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest key of each group of near duplicates."""
    rows, key = keyed(docs, "doc_id")
    classes = near_classes(rows, key, "text", SHINGLE, SIMILARITY)
    return _without(rows, key, classes.where(F.col(key) != F.col("class_id")).select(key), docs, "near-duplicates")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has; documents of which no word is left go."""
    cut, x = substring_dedup(docs)
    left = cut.where((F.col(f"`{x}`.n_removed") < F.col(f"`{x}`.n_words")) | (F.col(f"`{x}`.n_removed") == 0))
    text = F.when(F.col(f"`{x}`.n_removed") > 0, F.col(f"`{x}`.kept_text")).otherwise(F.col("text"))
    left = left.withColumn("text", text)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _columns(left, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, key = keyed(docs, "doc_id")
    found = leaks(rows, read_table(spark, sf_dir, "benchmark"), key, "text")
    return _without(rows, key, found.select(key).distinct(), docs, "leaky")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(docs, capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage's model and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
