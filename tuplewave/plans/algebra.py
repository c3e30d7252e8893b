"""Variables, constants, tuple patterns, graph patterns and queries; what makes a query valid."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class InvalidQueryError(ValueError):
    """The query text is not well formed."""


class IncompatibleQueryError(ValueError):
    """The query is well formed but uses a feature outside the supported subset."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A constant: an encoded term for term columns, a plain value for typed columns."""

    value: Any


@dataclass(frozen=True)
class TuplePattern:
    """A pattern over the first ``len(terms)`` positions of a relation's tuples."""

    terms: tuple[Var | Const, ...]
    relation: str = "triples"

    def __post_init__(self) -> None:
        if not self.terms:
            raise IncompatibleQueryError("a tuple pattern needs at least one term")

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))

    @property
    def shape(self) -> tuple:
        """The pattern with its variables numbered: equal for patterns that differ in variable names alone."""
        numbers = {v: i for i, v in enumerate(self.variables)}
        return (self.relation, *(("?", numbers[t.name]) if isinstance(t, Var) else ("=", t.value) for t in self.terms))


@dataclass(frozen=True)
class GraphPattern:
    patterns: tuple[TuplePattern, ...]

    def __post_init__(self) -> None:
        if not self.patterns:
            raise IncompatibleQueryError("a graph pattern needs at least one tuple pattern")

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for p in self.patterns for v in p.variables))

    def components(self) -> list[list[TuplePattern]]:
        """Groups of patterns that share variables, directly or not; shared constants do not count."""
        groups: list[tuple[set[str], list[TuplePattern]]] = []
        for p in self.patterns:
            names, own = set(p.variables), [p]
            apart = []
            for other, members in groups:
                if other & names:
                    names, own = names | other, members + own
                else:
                    apart.append((other, members))
            groups = [*apart, (names, own)]
        return [members for _, members in groups]

    def check(self) -> None:
        if any(not p.variables for p in self.patterns):
            raise IncompatibleQueryError("each tuple pattern needs a variable")
        if len(self.components()) > 1:
            raise IncompatibleQueryError("the patterns are not connected by variables")


@dataclass(frozen=True)
class Query:
    """What every accepted query comes down to.

    ``projection`` maps output names to variables or constants, in order; None means all variables.
    """

    graph: GraphPattern
    form: str = "SELECT"
    projection: tuple[tuple[str, Var | Const], ...] | None = None
    filters: tuple[Any, ...] = ()
    distinct: bool = False
    reduced: bool = False
    limit: int | None = None
    offset: int = 0
    hidden: frozenset[str] = field(default_factory=frozenset)

    def outputs(self) -> list[tuple[str, Var | Const]]:
        if self.form == "ASK":
            return []
        if self.projection is not None:
            return list(self.projection)
        return [(v, Var(v)) for v in self.graph.variables if v not in self.hidden]

    def check(self) -> None:
        self.graph.check()
        known = set(self.graph.variables)
        names = [n for n, _ in self.outputs()]
        if len(names) != len(set(names)):
            raise IncompatibleQueryError("an output name is used twice")
        for _, source in self.outputs():
            if isinstance(source, Var) and source.name not in known:
                raise IncompatibleQueryError(f"?{source.name} is not bound by a pattern")
        if (self.limit or 0) < 0 or self.offset < 0:
            raise InvalidQueryError("LIMIT and OFFSET must not be negative")
