"""Relations that tuple patterns range over, with optional arrival order and lifetimes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..plans.algebra import Const, IncompatibleQueryError, TuplePattern


@dataclass(frozen=True)
class Relation:
    """A DataFrame seen as tuples of ``columns``.

    ``seq`` orders arrivals, ``arrival`` and ``expires`` bound a tuple's life (a null expiry never ends). ``terms`` says
    that the columns hold encoded terms; otherwise they keep their own types. ``bag`` keeps repeated tuples; by
    default a repeated tuple counts once, from its first arrival to its latest expiry. ``key`` names columns of which no
    two tuples have equal values: patterns that hold them need no search for repeated tuples. ``span`` is the longest
    life in seconds on streams, which bounds what a join must remember.
    """

    df: DataFrame
    columns: tuple[str, ...]
    seq: str | None = None
    arrival: str | None = None
    expires: str | None = None
    terms: bool = False
    bag: bool = False
    key: tuple[str, ...] | None = None
    span: int | None = None

    def kind(self, position: int) -> DataType | None:
        return None if self.terms else self.df.schema[self.columns[position]].dataType


def triples(df: DataFrame, **options) -> Relation:
    return Relation(df, ("s", "p", "o"), terms=True, **options)


@dataclass
class Catalog:
    """Relations by name, and predicates that stand for two columns of a relation."""

    relations: dict[str, Relation] = field(default_factory=dict)
    predicates: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    def add(self, name: str, relation: Relation) -> Catalog:
        self.relations[name] = relation
        return self

    def predicate(self, term: str, relation: str, subject: str, object_: str) -> Catalog:
        self.predicates[term] = (relation, subject, object_)
        return self

    def resolve(self, pattern: TuplePattern) -> tuple[Relation, TuplePattern]:
        """The relation of a pattern, and the pattern over that relation's columns."""
        if pattern.relation == "triples" and self.predicates and len(pattern.terms) == 3:
            s, p, o = pattern.terms
            if isinstance(p, Const) and p.value in self.predicates:
                name, a, b = self.predicates[p.value]
                return replace(self.relations[name], columns=(a, b)), TuplePattern((s, o), name)
        if pattern.relation not in self.relations:
            raise IncompatibleQueryError(f"no relation for {pattern.relation}")
        return self.relations[pattern.relation], pattern

    def merged(self, patterns: list[TuplePattern]) -> list[tuple[Relation, TuplePattern]]:
        """The patterns resolved; those that read columns of one relation for one value of its key become one scan."""
        out: list[tuple[Relation, TuplePattern]] = []
        stars: dict[tuple, int] = {}
        for pattern in patterns:
            relation, own = self.resolve(pattern)
            subject = own.terms[0]
            if relation.key == relation.columns[:1] and len(own.terms) == len(relation.columns):
                at = stars.setdefault((own.relation, subject), len(out))
                if at < len(out):
                    before, star = out[at]
                    new = [(c, t) for c, t in zip(relation.columns[1:], own.terms[1:], strict=True) if (c, t) not in zip(before.columns, star.terms, strict=True)]
                    columns = (*before.columns, *(c for c, _ in new))
                    out[at] = replace(before, columns=columns), TuplePattern((*star.terms, *(t for _, t in new)), own.relation)
                    continue
            out.append((relation, own))
        return out


def replay(df: DataFrame, order: list[str], arrival: str, ttl_seconds: int | None = None) -> DataFrame:
    """Add ``seq`` and ``expires_at`` to recorded tuples; a lifetime of None or 0 never ends.

    ``seq`` is the arrival in microseconds with the given columns to break ties, so no global numbering is needed.
    """
    ends = F.lit(None).cast("timestamp") if not ttl_seconds else F.col(arrival) + F.expr(f"interval {int(ttl_seconds)} seconds")
    seq = F.struct(F.unix_micros(F.col(arrival).cast("timestamp")).alias("t"), *[F.col(c) for c in order])
    return df.withColumn("seq", seq).withColumn("expires_at", ends)
