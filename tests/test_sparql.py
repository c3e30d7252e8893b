"""The parser: what it accepts, what it refuses, and how."""

from __future__ import annotations

import pytest

from tuplewave.functions import terms as T
from tuplewave.plans.algebra import Const, GraphPattern, IncompatibleQueryError, InvalidQueryError, TuplePattern, Var
from tuplewave.plans.sparql import parse

P = "PREFIX : <http://x/> "


def test_forms_and_modifiers():
    q = parse(P + 'SELECT DISTINCT ?a (?b AS ?c) WHERE { ?a :p ?b ; :q "x"@en , 5 . FILTER (?b > 3 && isIRI(?a)) } OFFSET 2 LIMIT 7')
    assert [n for n, _ in q.outputs()] == ["a", "c"]
    assert (q.distinct, q.limit, q.offset, len(q.graph.patterns)) == (True, 7, 2, 3)
    assert q.graph.patterns[1].terms[2] == Const(T.literal("x", lang="en"))
    assert parse(P + "ASK { ?s a :C }").limit == 1
    built = parse(P + "CONSTRUCT { ?s :r :o } WHERE { ?s :p ?b }")
    assert built.reduced
    assert built.outputs()[2] == ("object", Const("Uhttp://x/o"))
    hidden = parse(P + "SELECT * WHERE { ?s :p [ :q ?y ] }")
    assert [n for n, _ in hidden.outputs()] == ["s", "y"]


@pytest.mark.parametrize("text", [
    "DESCRIBE ?s WHERE { ?s :p ?o }", "SELECT ?s WHERE { ?s :p ?o } ORDER BY ?s", "SELECT ?s WHERE { ?s :p ?o OPTIONAL { ?s :q ?x } }",
    "SELECT ?s WHERE { { ?s :p ?o } UNION { ?s :q ?o } }", "SELECT ?s WHERE { ?s :p ?o FILTER NOT EXISTS { ?s :q ?x } }",
    "SELECT ?s WHERE { ?s :p ?o FILTER (?o > 1) FILTER (?o < 3) }", "SELECT (strlen(?s) AS ?n) WHERE { ?s :p ?o }", "SELECT ?s WHERE { ?s :p/:q ?o }",
    "SELECT (COUNT(?s) AS ?n) WHERE { ?s :p ?o }", "SELECT ?s WHERE { ?s :p ?o } GROUP BY ?s", "CONSTRUCT { ?s :a ?o . ?o :b ?s } WHERE { ?s :p ?o }",
    "SELECT ?s WHERE { ?s :p ?o . ?x :q ?y }", "SELECT ?s WHERE { ?s :p :c . :c :q ?y }", "SELECT ?z WHERE { ?s :p ?o }", "SELECT ?s WHERE { ?s :p ?o . :a :b :c }",
    "SELECT ?s WHERE { ?s :p ?o BIND (1 AS ?x) }", "SELECT ?s WHERE { ?s :p ?o } VALUES ?s { :a }", "SELECT ?s WHERE { GRAPH :g { ?s :p ?o } }", "SELECT ?s WHERE { }",
])
def test_incompatible(text):
    with pytest.raises(IncompatibleQueryError):
        parse(P + text)


@pytest.mark.parametrize("text", ["SELECT ?s WHERE { ?s :p ", "CONSTRUCT { ?s :p } WHERE { ?s :p ?o }", "SELECT WHERE { ?s :p ?o }", "SELECT ?s WHERE { ?s nope:p ?o }", "SELECT ?s WHERE { ?s :p ?o } LIMIT -1", 'SELECT ?s WHERE { ?s :p "x }', "FROB ?s", "SELECT ?s WHERE { ?s :p ?o FILTER (strlen(?o, 2) > 1) }"])
def test_invalid(text):
    with pytest.raises(InvalidQueryError):
        parse(P + text)


def test_lenient():
    q = parse(P + "SELECT ?s WHERE { ?s :p ?o FILTER (?o > 1) FILTER (?o < 3) }", strict=False)
    assert len(q.filters) == 2


def test_patterns():
    x, y, z, w = map(Var, "xyzw")
    c = Const("c")
    connected = lambda *p: len(GraphPattern(tuple(TuplePattern(t) for t in p)).components()) == 1
    assert connected((x, c, y))
    assert connected((x, c, y), (y, c, z))
    assert connected((x, c, y), (z, c, w), (y, c, z))
    assert not connected((x, c, y), (z, c, w))
    assert not connected((x, c), (c, y))
    for empty in (lambda: TuplePattern(()), lambda: GraphPattern(())):
        with pytest.raises(IncompatibleQueryError):
            empty()
    assert TuplePattern((x, c, y)).shape == TuplePattern((z, c, w)).shape != TuplePattern((x, c, x)).shape
