"""Continuous queries: register first, push tuples, get each answer when it completes.

``StreamEngine`` takes micro-batches of statements, each with a time to live, and hands every subscription the answers
that the batch completes. The live tuples are tables in the shared folder, one for each batch, compacted as lives end.
Of a batch only what it adds is joined: for each pattern in turn its new tuples with the older ones of the patterns before
and all of those after, so each new answer comes once and the answers are those of a replay. Subscriptions that began
at the same tuple share the table of live tuples. ``attach`` drives the engine from a streaming DataFrame.

For unbounded streams whose state Spark itself should keep, ``stream_answers`` compiles a query to
stream-stream joins.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from itertools import product
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..operators.lifetime import retract, supersede
from ..operators.modifiers import REDUCED_CAPACITY, SeenSet
from ..plans.algebra import GraphPattern, IncompatibleQueryError, Query
from ..plans.compiler import compile_query
from ..plans.sparql import parse
from ..sources.linked_data import Resolver, expand, frontier, seeds
from ..sources.relations import Catalog, Relation
from .state import COMPACT_AFTER, TupleStore

INFINITE_TTL = 0
NEVER = None

Callback = Callable[[dict, float | None], None]


@dataclass
class Counters:
    queries: int = 0
    inputs: int = 0
    solutions: int = 0


@dataclass
class Subscription:
    """A registered query. ``expires`` is its own end of life in seconds, ``since`` the number of the last tuple that came
    too early for it; the modifiers' counters live here. ``answered`` names the tables of what a DISTINCT query has given."""

    id: str
    query: Query
    callback: Callback
    engine: StreamEngine
    since: int
    expires: float | None
    active: bool = True
    skipped: int = 0
    delivered: int = 0
    seen: SeenSet | None = None
    answered: list[str] = field(default_factory=list)

    def cancel(self) -> None:
        self.active = False
        self.engine.subscriptions.pop(self.id, None)
        for table in self.answered:
            self.engine.store.delete(table)
        self.answered.clear()

    def renew(self, ttl: int) -> bool:
        """A new life from now on; false if this has ended."""
        if not self.active or self.ended():
            return False
        self.expires = self.engine.end_of(ttl)
        return True

    def ended(self) -> bool:
        return self.expires is not None and self.engine.clock() > self.expires

    def offer(self, answer: dict, expiry: float | None) -> None:
        """REDUCED, then OFFSET, then LIMIT; the last answer of a limit cancels."""
        if not self.active:
            return
        q = self.query
        if q.reduced and not q.distinct and not self.seen.first(tuple(answer.values())):
            return
        if self.skipped < q.offset:
            self.skipped += 1
            return
        if q.limit is not None and self.delivered >= q.limit:
            return
        self.delivered += 1
        self.engine.solved(self.id, answer)
        self.callback(answer, expiry)
        if q.limit is not None and self.delivered >= q.limit:
            self.cancel()


class StreamEngine:
    """Statements ``(s, p, o)`` of encoded terms; quads lose their graph."""

    columns = ("s", "p", "o")

    def __init__(self, spark: SparkSession, capacity: int = REDUCED_CAPACITY, clock: Callable[[], float] | None = None, resolver: Resolver | None = None, log: Callable[[str], None] | None = None, compact: bool = False, cleanup: int | Callable[[int, int], bool] = COMPACT_AFTER) -> None:
        """``log`` takes a line for each solution and each batch; with ``compact`` only for batches with solutions, without
        the solutions. ``cleanup`` says when ended lives are swept (see ``TupleStore``)."""
        ship(spark)
        self.spark, self.capacity, self.resolver, self.log, self.compact = spark, capacity, resolver, log, compact
        self.clock = clock or time.time
        self.subscriptions: dict[str, Subscription] = {}
        self.counters = Counters()
        self.store = TupleStore(spark, self.columns, cleanup)
        self.known: DataFrame | None = None
        self.numbered = 0
        self.running: list = []

    # ---- time

    def set_clock(self, clock: Callable[[], float]) -> None:
        self.clock = clock

    def end_of(self, ttl: int) -> float | None:
        return None if ttl == INFINITE_TTL else self.clock() + ttl

    # ---- queries

    def add_query(self, ttl: int, query: str | Query, callback: Callback, backfill: bool = False) -> Subscription:
        """``backfill`` also answers from live tuples that came before; by default only answers that later tuples complete."""
        query = parse(query) if isinstance(query, str) else query
        query.check()
        self.numbered += 1
        own = Subscription(f"q{self.numbered}", query, callback, self, -1 if backfill else self.store.seq, self.end_of(ttl), seen=SeenSet(self.capacity))
        self.counters.queries += 1
        if query.limit == 0:
            return own  # nothing is ever delivered
        self.subscriptions[own.id] = own
        if self.resolver:
            self.known = None
            self._follow(seeds(self.spark, query))
        if backfill:
            self._answer(own, -1, {})
        return own

    def clear(self) -> None:
        for s in list(self.subscriptions.values()):
            s.cancel()
        self.store.clear()
        self.known = None
        self.counters = Counters()

    def shut_down(self) -> None:
        """End all subscriptions and the streams that feed this engine."""
        for s in list(self.subscriptions.values()):
            s.cancel()
        for stream in self.running:
            stream.stop()
        self.running.clear()

    # ---- tuples

    def add_inputs(self, ttl: int, statements: Iterable[tuple[str, str, str]]) -> bool:
        """Push statements in order; true if one of them matched a pattern of a registered query."""
        rows = [(*s[:3], i) for i, s in enumerate(statements)]
        if not rows:
            return False
        df = self.spark.createDataFrame(rows, "s string, p string, o string, nth long")
        return self.add_frame(ttl, df, len(rows))

    def add_frame(self, ttl: int, statements: DataFrame, count: int | None = None, batch: str | None = None) -> bool:
        """A micro-batch of any size; ``nth`` orders it if it has that column. One with the name of an earlier ``batch`` is
        the same delivered again, and ignored."""
        now = self.clock()
        for s in list(self.subscriptions.values()):
            if s.ended():
                s.cancel()
        before, solved = self.store.seq, self.counters.solutions
        added = self.store.append(self._relevant(statements), now, self.end_of(ttl), batch)
        self.counters.inputs += count if count is not None else added
        if not added:
            return False
        tables: dict[int, DataFrame] = {}
        for s in list(self.subscriptions.values()):
            self._answer(s, before, tables)
        for table in tables.values():
            table.unpersist()
        if self.log and (not self.compact or self.counters.solutions > solved):
            self.log(f"LOG\t{now},{self.clock()},{self.counters.queries},{self.counters.inputs},{self.counters.solutions}")
        if self.resolver:
            self._follow(frontier(self.store.since(before)))
        return True

    def remove(self, *pattern: str | None) -> bool:
        """End the life of matching tuples; None matches anything, a short pattern any tuple that begins so."""
        row = dict(zip(self.columns, [*pattern, None, None, None], strict=False))
        df = self.spark.createDataFrame([tuple(row.values())], "s string, p string, o string")
        return self.store.rewrite(lambda live: retract(live, list(self.columns), df))

    def _relevant(self, df: DataFrame) -> DataFrame:
        """Tuples that some pattern of a live query matches; others leave no state."""
        shapes = {p.shape: p for s in self.subscriptions.values() for p in s.query.graph.patterns}
        if not shapes:
            return df.limit(0)
        any_of = F.lit(False)
        for p in shapes.values():
            one, first = F.lit(True), {}
            for column, t in zip(self.columns, p.terms, strict=True):
                if hasattr(t, "value"):
                    one = one & (F.col(column) == F.lit(t.value))
                elif t.name in first:
                    one = one & (F.col(column) == F.col(first[t.name]))
                else:
                    first[t.name] = column
            any_of = any_of | one
        return df.where(any_of)

    def solved(self, name: str, answer: dict) -> None:
        self.counters.solutions += 1
        if self.log and not self.compact:
            self.log(f"SOLUTION\t{self.clock()},{name},{self.counters.solutions}")

    def _live(self, since: int, tables: dict[int, DataFrame]) -> DataFrame:
        """Live tuples that came after ``since``, each once, with its first arrival and last expiry; one table for a batch."""
        if since not in tables:
            live = self.store.live(self.clock(), since)
            tables[since] = supersede(live, list(self.columns), "seq", "arrival", "expires_at").persist(StorageLevel.DISK_ONLY)
        return tables[since]

    def _answer(self, s: Subscription, after: int, tables: dict[int, DataFrame]) -> None:
        if not s.active:
            return
        live = self._live(s.since, tables)
        relation = lambda df: Relation(df, self.columns, "seq", "arrival", "expires_at", terms=True, bag=True)
        parts = {"live": live, "new": live.where(F.col("seq") > after), "old": live.where(F.col("seq") <= after)}
        catalog = Catalog({name: relation(df) for name, df in parts.items()})
        plain = Query(s.query.graph, "SELECT", tuple(s.query.outputs()) or None, s.query.filters, hidden=s.query.hidden)
        patterns = list(dict.fromkeys(plain.graph.patterns))
        answers = None
        for i in range(len(patterns) if after >= 0 else 1):
            # New tuples of one pattern, older ones of those before it, all of those after it.
            names = ["old" if k < i else "new" if k == i else "live" for k in range(len(patterns))] if after >= 0 else ["live"] * len(patterns)
            own = GraphPattern(tuple(replace(p, relation=n) for p, n in zip(patterns, names, strict=True)))
            part = compile_query(replace(plain, graph=own), catalog, meta=True)
            answers = part if answers is None else answers.unionByName(part)
        ask = s.query.form == "ASK"
        if s.query.distinct and not ask:
            answers = self._unanswered(s, answers)
        # Answers go to a callback in this process one by one; a limit ends the pass.
        for row in answers.orderBy("emitted_at", *[f"`{c}`" for c in answers.columns if c not in ("emitted_at", "expires_at")]).toLocalIterator():
            values = row.asDict()
            end = values.pop("expires_at")
            values.pop("emitted_at")
            expiry = None if end is None else end.replace(tzinfo=timezone.utc).timestamp()
            s.offer({} if ask else values, expiry)
            if not s.active:
                break

    def _unanswered(self, s: Subscription, answers: DataFrame) -> DataFrame:
        """Each answer once, and only those that ``s`` has not given; what it gives now is written beside the tuples."""
        names = [n for n, _ in s.query.outputs()]
        last = F.when(F.count(F.lit(1)) == F.count("expires_at"), F.max("expires_at")).alias("expires_at")
        new = answers.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.min("emitted_at").alias("emitted_at"), last)
        if s.answered:
            given = self.spark.read.schema(new.schema).parquet(*s.answered)
            same = F.lit(True)
            for n in names:
                same = same & new[f"`{n}`"].eqNullSafe(given[f"`{n}`"])
            new = new.join(given, same, "left_anti")
        s.answered.append(self.store.write(new))
        return self.spark.read.schema(new.schema).parquet(s.answered[-1])

    def _follow(self, wanted: DataFrame) -> None:
        found, self.known = expand(self.resolver, wanted, self.known)
        rows = found.limit(1).head(1)
        if rows:
            self.add_frame(INFINITE_TTL, found)

    # ---- streams

    def attach(self, stream: DataFrame, ttl: int = INFINITE_TTL, trigger: dict | None = None, checkpoint: str | None = None):
        """Feed the engine from a streaming DataFrame with s, p, o; returns the running StreamingQuery, which ``shut_down``
        stops. A micro-batch that Spark delivers again after a failure is taken once."""
        name = checkpoint or uuid.uuid4().hex

        def step(batch: DataFrame, number: int) -> None:
            self.add_frame(ttl, batch, batch=f"{name}/{number}")

        writer = stream.writeStream.foreachBatch(step).trigger(**(trigger or {"availableNow": True}))
        query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
        self.running.append(query)
        return query


def stream_answers(query: str | Query, stream: DataFrame, arrival: str | None = None, expires: str | None = None, static: DataFrame | None = None, late: str | None = None, span: int | None = None) -> DataFrame:
    """The query over a stream of triples as stream-stream inner joins in append mode.

    ``static`` triples join too, each pattern taking them or the stream's; answers of static triples alone are those of the
    batch query and do not come here. Repeated triples count once. With ``late``, a delay, a watermark on ``arrival`` bounds
    how long repeats are remembered, and with ``span``, the longest life in seconds, how long tuples wait in joins. Where
    triples have lives, a repeated one has each of its lives, and repeated answers are left out instead. LIMIT holds for the
    whole stream; REDUCED is what it permits, all answers or fewer; OFFSET has no meaning without an order and is refused.
    """
    query = parse(query) if isinstance(query, str) else query
    if query.offset:
        raise IncompatibleQueryError("OFFSET over a stream: register the query with an engine")
    columns = ["s", "p", "o"]
    if arrival and late:
        stream = stream.withWatermark(arrival, late)
    once = (lambda df, names: df.dropDuplicatesWithinWatermark(names)) if arrival and late else (lambda df, names: df.dropDuplicates(names))
    if not expires:
        stream = once(stream, columns)
    catalog = Catalog().add("triples", Relation(stream, tuple(columns), None, arrival, expires, terms=True, span=span))
    patterns = list(dict.fromkeys(query.graph.patterns))
    ways = [("triples",) * len(patterns)]
    if static is not None:
        held = static.select(*columns).distinct()
        if arrival:
            held = held.withColumn(arrival, F.lit("1970-01-01 00:00:00").cast("timestamp"))
        if expires:
            held = held.withColumn(expires, F.lit(None).cast("timestamp"))
        catalog.add("static", Relation(held, tuple(columns), None, arrival, expires, terms=True))
        ways = [w for w in product(("triples", "static"), repeat=len(patterns)) if "triples" in w]
    plain = replace(query, distinct=False, reduced=False, limit=None)
    out = None
    for way in ways:
        own = GraphPattern(tuple(replace(p, relation=r) for p, r in zip(patterns, way, strict=True)))
        part = compile_query(replace(plain, graph=own), catalog, streaming=True, meta=arrival is not None)
        out = part if out is None else out.unionByName(part)
    names = [n for n, _ in query.outputs()] or out.columns
    if query.form != "ASK" and (query.distinct or expires):
        out = out.dropDuplicates(names)
    return out.limit(query.limit) if query.limit is not None and query.form != "ASK" else out


def utc(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


__all__ = ["INFINITE_TTL", "Counters", "Row", "StreamEngine", "Subscription", "stream_answers"]
