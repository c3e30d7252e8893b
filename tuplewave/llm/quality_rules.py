"""Quality rules as a short-circuit cascade, native expressions only.

Nulls: a null text has no words, so it fails the base rule; a null id is carried along. Empty texts likewise.
Repeated rows are judged one by one. An empty table gives an empty result. Columns that clash with the measured
ones are not used: only the id and the text are read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, blank

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Timed runs of a rule on the sample.
TIMED = 2


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to drop; it may use ``text``, ``hashes`` of the words and the measured columns."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", F.col("n_symbols") * 100 > 30 * n),
        Rule("duplicate_lines", F.col("n_dup_lines") * 100 > 50 * F.size(F.split(F.col("text"), "\n", -1))),
        Rule("few_distinct_words", (n >= 50) & (F.size(F.array_distinct("hashes")) * 10 < n)),
        Rule("capitals", F.regexp_count("text", F.lit(r"[A-Z]{3,}")) * 10 > 5 * n),
        Rule("digits", F.regexp_count("text", F.lit(r"[0-9]")) * 10 > F.col("word_chars") * 5),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text, hashes of the words and the base counts. Each step names an array once so that no lambda evaluates it anew.

    Windows are compared by 64-bit hashes within one text; positions of equal hashes are found by sorting, so a
    text of n words costs n log n however often it repeats itself.
    """
    text = F.col("text")
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    df = docs.select(F.col(id_col).alias(id_col), blank(F.col(text_col)).alias("text"))
    df = df.select("*", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)).alias("words"), F.filter(F.split(text, "\n", -1), has_word).alias("lines"))
    df = df.select(
        id_col, "text",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    fixed = df.columns
    twice = lambda c, step: F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + step)))
    longs = F.array().cast("array<bigint>")
    # Hashes of 2, 4 and 8 words by doubling; eight only where four repeat. Those at the end cover fewer words.
    df = df.select(*fixed, twice("hashes", 1).alias("h2"))
    df = df.select(*fixed, twice("h2", 2).alias("h4"))
    some = (F.size("h4") > WINDOW) & (F.size(F.array_distinct("h4")) < F.size("h4"))
    df = df.select(*fixed, F.when(some, twice("h4", 4)).otherwise(longs).alias("h8"))
    whole = F.slice("h8", F.lit(1), F.size("h8") - (WINDOW - 1))
    df = df.select(*fixed, F.when(F.size("h8") > 0, whole).otherwise(longs).alias("windows"))
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.select(*[c for c in df.columns if c != "windows"], F.when(repeated, F.sort_array(pairs)).otherwise(none).alias("sorted"))
    same = lambda x, i, d: F.coalesce(F.get("sorted", i + d)["h"] == x["h"], F.lit(False))
    at = F.transform("sorted", lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"]))
    df = df.select(*[c for c in df.columns if c != "sorted"], F.sort_array(F.filter(at, lambda x: x.isNotNull())).alias("starts"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, x: F.struct((acc["total"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("total"), x.alias("last"))
    return df.select(*[c for c in df.columns if c != "starts"], F.aggregate("starts", start, step, lambda acc: acc["total"]).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def order_rules(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str, sample_rows: int, sample_chars: int) -> list[Rule]:
    """Order by rejections per second, both found on at most ``sample_rows`` texts of at most ``sample_chars``.

    A rule's time is the shortest of a few runs after one that compiles it, less that of a rule that looks at nothing.

    The order changes only the work done, never a verdict, because a text is kept when no rule rejects it.
    """
    spark = docs.sparkSession
    fit = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).where(F.char_length("text") <= sample_chars)
    rows = fit.select("text").limit(sample_rows).collect()
    if not rows:
        return rules
    sample = measure(spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], f"`{id_col}` long, text string").repartition(2), id_col, "text").cache()
    try:
        sample.count()
        def measured(rejects: Column) -> tuple[int, float]:
            counted, took = sample.agg(F.count_if(rejects)), []
            for _ in range(TIMED + 1):
                began = time.perf_counter()
                rejected = counted.head()[0]
                took.append(time.perf_counter() - began)
            return rejected, min(took[1:])

        _, nothing = measured(F.lit(False))
        found = [(rule, *measured(rule.rejects)) for rule in rules]
        rank = [(rejected / max(took - nothing, 1e-4), rule) for rule, rejected, took in found]
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(rank, key=lambda x: -x[0])]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 512, sample_chars: int = 200_000) -> DataFrame:
    """Id, the base counts, ``base_failed`` and ``kept``; costlier rules run only for texts that passed the others."""
    ordered = order_rules(docs, default_rules() if rules is None else rules, id_col, text_col, sample_rows, sample_chars)
    kept = F.when(F.col("base_failed"), F.lit(False))
    for rule in ordered:
        kept = kept.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False))
    judged = measure(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.otherwise(F.lit(True)).alias("kept"))
