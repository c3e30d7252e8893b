"""Basic graph patterns as scans and inner equality joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import terms as T
from ..plans.algebra import Const, GraphPattern, IncompatibleQueryError, TuplePattern
from ..sources.relations import Catalog, Relation
from .lifetime import alive_together, earliest, supersede

SEQ, ARRIVAL, EXPIRES = "__seq", "__arrival", "__expires_at"


@dataclass(frozen=True)
class Matched:
    """Solutions: a column for each variable, the type of each (None: term), and the meta columns in use."""

    df: DataFrame
    kinds: dict[str, DataType | None]
    seq: bool
    lives: bool


def _plain(value: object, kind: DataType | None) -> Column:
    """A constant for a column: terms as they are, for typed columns the literal's text in the column's type."""
    if kind is None or not isinstance(value, str):
        return F.lit(value)
    text = T.parts(value)[1] if value.startswith("L") and value.count(T.CUT) >= 2 else value[1:] if value.startswith("U") and ":" in value else value
    return F.lit(text).try_cast(kind)


def scan(relation: Relation, pattern: TuplePattern, streaming: bool = False) -> DataFrame:
    """Constants become filters that reach the source, repeated variables an equality of two columns.

    Only the columns that a variable needs are kept. Repeated tuples are looked for only where the pattern does not hold
    the relation's key.
    """
    if len(pattern.terms) > len(relation.columns):
        raise IncompatibleQueryError(f"{relation.columns} has fewer positions than the pattern")
    df, first = relation.df, {}
    for position, (term, column) in enumerate(zip(pattern.terms, relation.columns, strict=False)):
        if isinstance(term, Const):
            df = df.where(F.col(column) == _plain(term.value, relation.kind(position)))
        elif term.name in first:
            df = df.where(F.col(first[term.name]) == F.col(column))
        else:
            first[term.name] = column
    meta = [(c, name) for c, name in ((relation.seq, SEQ), (relation.arrival, ARRIVAL), (relation.expires, EXPIRES)) if c]
    df = df.select(*[F.col(c).alias(v) for v, c in first.items()], *[F.col(c).alias(n) for c, n in meta])
    for v in first:
        df = df.where(F.col(f"`{v}`").isNotNull())
    if relation.bag or streaming or (relation.key and set(relation.key) <= set(relation.columns[: len(pattern.terms)])):
        return df
    names = [n for _, n in meta]
    return supersede(df, list(first), *[n if n in names else None for n in (SEQ, ARRIVAL, EXPIRES)])


def estimated_rows(df: DataFrame) -> float:
    """What the optimizer knows of a frame's size, by the width of its rows; no job runs."""
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1.0, size / (8 + sum(f.dataType.jsonValue() == "string" and 20 or 8 for f in df.schema)))


@dataclass(frozen=True)
class Sized:
    """A pattern for the order of joins: its variables, the rows it may have, the sets of variables that are keys of it."""

    variables: frozenset[str]
    rows: float
    keys: tuple[frozenset[str], ...] = ()


def sized(relation: Relation, pattern: TuplePattern, rows: float) -> Sized:
    bound = {c: t for c, t in zip(relation.columns, pattern.terms, strict=False)}
    keys = []
    if relation.key and set(relation.key) <= set(bound):
        keys.append(frozenset(bound[c].name for c in relation.key if not isinstance(bound[c], Const)))
    fixed = sum(isinstance(t, Const) for t in pattern.terms)
    return Sized(frozenset(pattern.variables), 1.0 if keys and not keys[0] else max(1.0, rows * 0.1**fixed), tuple(keys))


def _joined(a: Sized, b: Sized) -> tuple[bool, Sized]:
    """Whether a key joins them, so that the result is no larger than one side; and the result."""
    shared = a.variables & b.variables
    both = a.variables | b.variables
    if any(k <= shared for k in b.keys):
        return True, Sized(both, a.rows, a.keys)
    if any(k <= shared for k in a.keys):
        return True, Sized(both, b.rows, b.keys)
    return False, Sized(both, a.rows * b.rows / max(a.rows, b.rows) ** 0.5, ())


def join_order(patterns: list[Sized]) -> list[int]:
    """Each pattern after one it shares a variable with: joins by a key first, then those with the smallest result.

    All patterns are tried as the first; the order with the fewest joins without a key, then the smallest results, is taken.
    """
    best = None
    for start in range(len(patterns)):
        order, now, loose, cost = [start], patterns[start], 0, patterns[start].rows
        left = [i for i in range(len(patterns)) if i != start]
        while left:
            near = [i for i in left if now.variables & patterns[i].variables] or left
            ranked = [(not keyed, after.rows, i, after) for i in near for keyed, after in [_joined(now, patterns[i])]]
            unkeyed, rows, i, now = min(ranked, key=lambda x: x[:3])
            loose, cost = loose + unkeyed, cost + rows
            order.append(i)
            left.remove(i)
        if best is None or (loose, cost) < best[0]:
            best = (loose, cost), order
    return best[1] if best else []


def match(catalog: Catalog, patterns: list[TuplePattern], streaming: bool = False) -> Matched:
    """Join connected patterns on all the variables they share."""
    df, kinds = None, {}
    seqs: list[str] = []
    arrivals: list[str] = []
    expiries: list[str] = []
    patterns = list(dict.fromkeys(patterns))
    found = [catalog.resolve(p) for p in patterns] if streaming else catalog.merged(patterns)
    parts = [scan(relation, own, streaming) for relation, own in found]
    rows = [1.0 if streaming or len(parts) == 1 else estimated_rows(part) for part in parts]
    spans = [relation.span for relation, _ in found]
    for i in join_order([sized(relation, own, n) for (relation, own), n in zip(found, rows, strict=True)]):
        (relation, own), part = found[i], parts[i]
        for c, group in ((SEQ, seqs), (ARRIVAL, arrivals), (EXPIRES, expiries)):
            if c in part.columns:
                part = part.withColumnRenamed(c, f"{c}_{i}")
                group.append(f"{c}_{i}")
        for position, term in enumerate(own.terms):
            if not isinstance(term, Const):
                kinds.setdefault(term.name, relation.kind(position))
        shared = [v for v in own.variables if df is not None and v in df.columns]
        if df is not None and not shared:
            raise IncompatibleQueryError("the patterns are not connected by variables")
        if df is None:
            df = part
            continue
        near = [(a, f"{ARRIVAL}_{i}") for a in arrivals if streaming and f"{ARRIVAL}_{i}" in part.columns and a in df.columns and all(spans)]
        if near:
            # On streams, tuples farther apart than the longest life need not be remembered.
            part = part.select([F.col(f"`{c}`").alias(f"__right_{c}" if c in shared else c) for c in part.columns])
            on = F.lit(True)
            for v in shared:
                on = on & (F.col(f"`{v}`") == F.col(f"`__right_{v}`"))
            life = F.expr(f"interval {max(spans)} seconds")
            for a, b in near:
                on = on & (F.col(b) <= F.col(a) + life) & (F.col(a) <= F.col(b) + life)
            df = df.join(part, on).drop(*[f"__right_{v}" for v in shared])
        else:
            df = df.join(part, shared)
    made: dict[str, Column] = {}
    at = [F.col(c) for c in arrivals]
    ends = [F.col(c) for c in expiries]
    if ends and at:
        df = df.where(alive_together(at, ends))
    if seqs:
        made[SEQ] = F.col(seqs[0]) if len(seqs) == 1 else F.greatest(*map(F.col, seqs))
    if at:
        made[ARRIVAL] = at[0] if len(at) == 1 else F.greatest(*at)
    if ends:
        made[EXPIRES] = earliest(ends)
    out = df.select(*[F.col(f"`{v}`") for v in kinds], *[c.alias(n) for n, c in made.items()])
    return Matched(out, kinds, bool(seqs), bool(ends))


def solve(catalog: Catalog, graph: GraphPattern, streaming: bool = False) -> list[Matched]:
    """The solutions of each connected component (one in strict queries)."""
    return [match(catalog, c, streaming) for c in graph.components()]
