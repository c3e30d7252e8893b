"""Queries to DataFrames. Catalyst pushes the filters down, prunes columns and picks the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Value, condition, typed
from ..operators.bgp import ARRIVAL, EXPIRES, SEQ, Matched, solve
from ..operators.modifiers import sliced
from ..sources.relations import Catalog
from .algebra import Const, GraphPattern, IncompatibleQueryError, Query, Var
from .sparql import parse


def _terms(expr: object) -> list[Var]:
    if isinstance(expr, Var):
        return [expr]
    return [v for e in expr for v in _terms(e)] if isinstance(expr, (tuple, list)) else []


def _conjuncts(expr: object) -> list:
    return [c for e in expr[1:] for c in _conjuncts(e)] if isinstance(expr, tuple) and expr[0] == "&&" else [expr]


def _connect(parts: list[Matched], filters: list) -> Matched:
    """Join components on a FILTER's equalities between them; a product without a condition is refused."""
    done = parts.pop(0)
    equal = [c for f in filters for c in _conjuncts(f) if isinstance(c, tuple) and c[0] == "="]
    while parts:
        for part in parts:
            binding = lambda name, kinds=done.kinds | part.kinds: typed(F.col(f"`{name}`"), kinds[name])
            sides = [(a, b) if all(v.name in done.kinds for v in _terms(a)) else (b, a) for _, a, b in equal]
            sides = [(a, b) for a, b in sides if _terms(a) and _terms(b) and all(v.name in done.kinds for v in _terms(a)) and all(v.name in part.kinds for v in _terms(b))]
            if sides:
                break
        else:
            raise IncompatibleQueryError("the patterns are not connected")
        parts.remove(part)
        if done.seq or part.seq or done.lives or part.lives:
            raise IncompatibleQueryError("components with lifetimes must be connected by variables")
        on = F.lit(True)
        for a, b in sides:
            from ..functions.expressions import evaluate, number, term

            x, y = evaluate(a, binding), evaluate(b, binding)
            # Value equality as one hashable key: the number if it is one, else the term.
            key = lambda v: F.coalesce(number(v).cast("double").cast("string"), term(v))
            on = on & (key(x) == key(y))
        done = Matched(done.df.join(part.df, on), done.kinds | part.kinds, False, False)
    return done


def compile_query(query: Query | str, catalog: Catalog, strict: bool = True, deadline: object = None, after: object = None, streaming: bool = False, meta: bool = False) -> DataFrame:
    """The answers of a query.

    Batch answers are ordered for LIMIT and OFFSET by arrival, ties by bindings. ``deadline`` keeps answers that complete
    by that time (a query's own lifetime), ``after`` those that complete after that arrival number. ``meta`` adds
    ``emitted_at`` and ``expires_at`` where the relations have them. REDUCED, and so CONSTRUCT, removes all repeats, which it
    permits and which combines before the shuffle. On streams there is no REDUCED, OFFSET or LIMIT here: their
    counters belong to the subscription. ASK gives one row with the column ``answer``, or none.
    """
    if isinstance(query, str):
        query = parse(query, strict)
    if strict:
        query.check()
    parts = solve(catalog, GraphPattern(tuple(dict.fromkeys(query.graph.patterns))), streaming)
    found = parts[0] if len(parts) == 1 else _connect(parts, list(query.filters))
    df, kinds = found.df, found.kinds

    def binding(name: str) -> Value:
        return typed(F.col(f"`{name}`"), kinds[name]) if name in kinds else Value("term", F.lit(None).cast("string"))

    for f in query.filters:
        df = df.where(condition(f, binding))
    if deadline is not None:
        df = df.where(F.col(ARRIVAL) <= F.lit(deadline).cast(df.schema[ARRIVAL].dataType))
    if after is not None:
        df = df.where(F.col(SEQ) > F.lit(after))
    outputs = query.outputs()
    extra = [c for c in (SEQ, ARRIVAL, EXPIRES) if c in df.columns]
    rest = [v for v in sorted(kinds)]
    names = [n for n, _ in outputs]
    shown = [(F.col(f"`{s.name}`") if isinstance(s, Var) else F.lit(s.value)).alias(n) for n, s in outputs]
    once = query.distinct or (query.reduced and not meta and not streaming)
    inner = [F.col(f"`{v}`").alias(f"__by_{i}") for i, v in enumerate(rest)] if not once else []
    df = df.select(*shown, *inner, *[F.col(c) for c in extra])
    order = [F.col(SEQ)] * (SEQ in extra) + [F.col(c) for c in df.columns if c.startswith("__by_")]
    if query.form == "ASK":
        return df.limit(1).select(F.lit(True).alias("answer"))
    if once:
        if streaming:
            df = df.dropDuplicates(names)
        else:
            # A distinct answer is emitted when it first completes and lives as long as its longest-lived solution.
            ends = F.when(F.count(F.lit(1)) == F.count(EXPIRES), F.max(EXPIRES)).alias(EXPIRES) if EXPIRES in extra else None
            keep = [F.min(c).alias(c) for c in extra if c != EXPIRES] + [ends] * (ends is not None)
            df = df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*keep) if keep else df.select(*names).distinct()
        order = [F.col(SEQ)] * (SEQ in extra) + [F.col(f"`{n}`") for n in names]
    tail = [F.col(ARRIVAL).alias("emitted_at")] * (meta and ARRIVAL in extra) + [F.col(EXPIRES).alias("expires_at")] * (meta and EXPIRES in extra)
    if streaming:
        return df.select(*names, *tail)
    return sliced(df, [*names, *tail], order, query.offset, query.limit)
