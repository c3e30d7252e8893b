"""Connected components by alternating large-star and small-star contractions, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Parts into which a node's links are dealt.
SALTS = 64


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``u`` links to its larger neighbours (large star) or to its smaller ones (small star) through the least of all.

    The least neighbour is an aggregate that combines before the shuffle. It is joined back by the node and a salt of
    the neighbour, once for each salt in use, so a node with very many neighbours is never gathered in one place.
    """
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))

    def joined(links: DataFrame, least: DataFrame) -> DataFrame:
        return links.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select(F.col("v").alias("src"), F.col("m").alias("dst"))

    if large:
        both = salted(pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(pairs.select(F.col("dst").alias("u"), F.col("src").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.collect_set("salt").alias("salts"))
        out = joined(both.where(F.col("v") > F.col("u")), least)
    else:
        down = salted(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("salt").alias("salts"))
        out = joined(down, least).union(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    # A large star has a row for each pair at most, so only the small star's rows are made distinct.
    out = out.where(F.col("src") != F.col("dst"))
    return out if large else out.distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root``: the least node of its component, for every node of a link ``src``-``dst`` of longs."""
    pairs = links.where(F.col("src") != F.col("dst")).select("src", "dst")
    state, before = None, None
    for _ in range(most_rounds):
        table = materialize(_star(_star(pairs, True), False), "components")
        mark = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head()
        if state is not None:
            drop_table(state)
        state, pairs = table, table
        if mark == before:
            return state.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
