"""Lifetimes: superseding repeated tuples, retraction, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def supersede(df: DataFrame, columns: list[str], seq: str | None, arrival: str | None, expires: str | None) -> DataFrame:
    """Each tuple once: first arrival, latest expiry, where no expiry is later than any. Combines before the shuffle.

    A tuple that comes back after its life ended starts a new life; lives that touch or overlap are one.
    """
    if arrival is None or expires is None:
        keep = [F.min(c).alias(c) for c in (seq, arrival) if c] + ([F.when(F.count(F.lit(1)) == F.count(expires), F.max(expires)).alias(expires)] if expires else [])
        return df.groupBy(*columns).agg(*keep) if keep else df.select(*columns).distinct()
    from pyspark.sql import Window as W

    forever = F.lit("9999-12-31 00:00:00").cast("timestamp")
    order = W.partitionBy(*columns).orderBy(arrival)
    ends = F.max(F.coalesce(F.col(expires), forever)).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.select(*columns, *([seq] if seq and seq != arrival else []), arrival, expires, F.coalesce((F.col(arrival) > ends).cast("int"), F.lit(0)).alias("__new"))
    lives = marked.withColumn("__life", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.when(F.count(F.lit(1)) == F.count(expires), F.max(expires)).alias(expires)
    return lives.groupBy(*columns, "__life").agg(*[F.min(c).alias(c) for c in dict.fromkeys((seq, arrival)) if c], last).drop("__life")


def alive_together(arrivals: list[Column], expiries: list[Column]) -> Column:
    """All tuples live when the last arrives; the end of a life belongs to it. Nulls never end."""
    last = arrivals[0] if len(arrivals) == 1 else F.greatest(*arrivals)
    ok = F.lit(True)
    for e in expiries:
        ok = ok & (e.isNull() | (last <= e))
    return ok


def earliest(expiries: list[Column]) -> Column:
    """The shortest life; null if none ends."""
    return expiries[0] if len(expiries) == 1 else F.least(*expiries)


def retract(df: DataFrame, columns: list[str], retractions: DataFrame, arrival: str | None = None, expires: str | None = None) -> DataFrame:
    """End the life of tuples that match a retraction; null positions match anything, missing ones are ignored.

    ``retractions`` has columns named like ``columns`` (a prefix of them) and, with ``arrival``, ``arrival``: the time of
    the retraction. Without it, matching tuples are removed. One equality join for each pattern of nulls in use.
    """
    own = [c for c in columns if c in retractions.columns]
    shapes = [tuple(r) for r in retractions.select(*[F.col(c).isNotNull().alias(c) for c in own]).distinct().collect()]  # at most 2**arity rows
    for shape in shapes:
        fixed = [c for c, used in zip(own, shape, strict=True) if used]
        rows = retractions.where(" and ".join(f"`{c}` is {'not ' if u else ''}null" for c, u in zip(own, shape, strict=True)) or "true")
        if arrival is None:
            df = df.join(rows.select(*fixed).distinct(), fixed, "left_anti") if fixed else df.limit(0)
            continue
        times = rows.groupBy(*fixed).agg(F.sort_array(F.collect_set("arrival")).alias("__times")) if fixed else rows.agg(F.sort_array(F.collect_set("arrival")).alias("__times"))
        df = df.join(times, fixed, "left") if fixed else df.crossJoin(times)  # one row
        df = df.withColumn(expires, F.least(F.col(expires), F.try_element_at(F.filter("__times", lambda t: t >= F.col(arrival)), F.lit(1)))).drop("__times")
    return df
