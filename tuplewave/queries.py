"""The registered graph queries over the star schema, with their SQL.

(R) queries see typed relations through predicates; (T) queries see a view of encoded triples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .functions import terms as T
from .operators.lifetime import retract
from .plans.algebra import Const, GraphPattern, Query, TuplePattern, Var
from .plans.compiler import compile_query
from .sources.linked_data import table_resolver
from .sources.rdf import BAD_IRI, parse_lines, read_triples, to_ntriples
from .sources.relations import Catalog, Relation, replay
from .streaming.engine import INFINITE_TTL, StreamEngine, stream_answers
from .streaming.state import shared_folder

NS = "http://example.org/"
PREFIX = f"PREFIX : <{NS}> PREFIX xsd: <{T.XSD}> "

#: predicate -> (table, subject, object)
PREDICATES = {
    "status": ("orders", "o_orderkey", "o_orderstatus"), "placedBy": ("orders", "o_orderkey", "o_custkey"), "total": ("orders", "o_orderkey", "o_totalprice"),
    "orderDate": ("orders", "o_orderkey", "o_orderdate"), "priority": ("orders", "o_orderkey", "o_orderpriority"),
    "customerNation": ("customer", "c_custkey", "c_nationkey"), "segment": ("customer", "c_custkey", "c_mktsegment"), "balance": ("customer", "c_custkey", "c_acctbal"), "customerName": ("customer", "c_custkey", "c_name"),
    "nationName": ("nation", "n_nationkey", "n_name"), "nationRegion": ("nation", "n_nationkey", "n_regionkey"), "regionName": ("region", "r_regionkey", "r_name"),
    "supplierNation": ("supplier", "s_suppkey", "s_nationkey"), "supplierName": ("supplier", "s_suppkey", "s_name"),
    "bySupplier": ("lineitem", "l_orderkey", "l_suppkey"), "ofPart": ("lineitem", "l_orderkey", "l_partkey"), "quantity": ("lineitem", "l_orderkey", "l_quantity"),
    "partName": ("part", "p_partkey", "p_name"), "brand": ("part", "p_partkey", "p_brand"), "price": ("part", "p_partkey", "p_retailprice"), "partSize": ("part", "p_partkey", "p_size"),
    "did": ("events", "user_id", "event_type"), "eventTime": ("events", "event_id", "ts"), "eventUser": ("events", "event_id", "user_id"), "eventType": ("events", "event_id", "event_type"),
}

#: What no two rows of a table share; line items have a key of more columns than any predicate reads.
KEYS = {"orders": ("o_orderkey",), "customer": ("c_custkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "events": ("event_id",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    ship(spark)
    out = Catalog()
    for name in sorted({t for t, _, _ in PREDICATES.values()}):
        df = table(spark, sf_dir, name)
        out.add(name, Relation(df, tuple(df.columns), key=KEYS.get(name)))
    for predicate, (name, s, o) in PREDICATES.items():
        out.predicate(T.iri(NS + predicate), name, s, o)
    return out


def sparql(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: compile_query(PREFIX + text, catalog(spark, sf_dir), **options)


def triple_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, region, customer and their links as encoded triples."""
    node = lambda kind, c: F.concat(F.lit(f"U{NS}{kind}/"), F.col(c).cast("string"))
    text = lambda c: T.literal_column(F.col(c))
    number = lambda c: T.literal_column(F.col(c), T.INTEGER)
    rows = [
        ("region", node("region", "r_regionkey"), "name", text("r_name")),
        ("nation", node("nation", "n_nationkey"), "name", T.literal_column(F.col("n_name")).alias("x")),
        ("nation", node("nation", "n_nationkey"), "inRegion", node("region", "n_regionkey")),
        ("customer", node("customer", "c_custkey"), "inNation", node("nation", "c_nationkey")),
        ("customer", node("customer", "c_custkey"), "key", number("c_custkey")),
        ("customer", node("customer", "c_custkey"), "segment", F.concat(F.lit(f"L{T.LANG_STRING}{T.CUT}en{T.CUT}"), F.col("c_mktsegment"))),
    ]
    out = None
    for name, s, p, o in rows:
        part = table(spark, sf_dir, name).select(s.alias("s"), F.lit(f"U{NS}{p}").alias("p"), o.alias("o"))
        out = part if out is None else out.union(part)
    return out


def triples(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return compile_query(PREFIX + text, Catalog().add("triples", Relation(triple_view(spark, sf_dir), ("s", "p", "o"), terms=True)), **options)

    return run


def _lit(kind: str, column: str, lang: str = "") -> str:
    return f"'L{kind}' || chr(1) || '{lang}' || chr(1) || {column}"


_T = f"""WITH t AS (SELECT 'U{NS}region/' || r_regionkey AS s, 'U{NS}name' AS p, {_lit(T.STRING, 'r_name')} AS o FROM region
UNION SELECT 'U{NS}nation/' || n_nationkey, 'U{NS}name', {_lit(T.STRING, 'n_name')} FROM nation
UNION SELECT 'U{NS}nation/' || n_nationkey, 'U{NS}inRegion', 'U{NS}region/' || n_regionkey FROM nation
UNION SELECT 'U{NS}customer/' || c_custkey, 'U{NS}inNation', 'U{NS}nation/' || c_nationkey FROM customer
UNION SELECT 'U{NS}customer/' || c_custkey, 'U{NS}key', {_lit(T.INTEGER, 'c_custkey')} FROM customer
UNION SELECT 'U{NS}customer/' || c_custkey, 'U{NS}segment', {_lit(T.LANG_STRING, 'c_mktsegment', 'en')} FROM customer) """


# ---- tuple patterns over N-ary relations


def _tuples(name: str, terms: list, columns: list[str] | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        relation = Relation(df.selectExpr(*columns) if columns else df, tuple((df.selectExpr(*columns) if columns else df).columns), **options)
        return compile_query(Query(GraphPattern((TuplePattern(tuple(terms), name),))), Catalog().add(name, relation))

    return run


def _edges(spark: SparkSession, sf_dir: str) -> Catalog:
    """A directed graph over all customers, who each know two others: it grows with the table, and so do its paths."""
    df = table(spark, sf_dir, "customer")
    n = max(df.count(), 1)
    first, second = (df.selectExpr("c_custkey as a", "'knows' as p", f"(c_custkey * {k} + c_nationkey) % {n} as b") for k in (7, 3))
    return Catalog().add("edges", Relation(first.union(second), ("a", "p", "b")))


_EDGES = "WITH e AS (SELECT c_custkey AS a, (c_custkey * 7 + c_nationkey) % (SELECT count(*) FROM customer) AS b FROM customer UNION SELECT c_custkey, (c_custkey * 3 + c_nationkey) % (SELECT count(*) FROM customer) FROM customer) "


def _path(*ends: tuple[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    patterns = tuple(TuplePattern((Var(a), Const("knows"), Var(b)), "edges") for a, b in ends)
    return lambda spark, sf_dir: compile_query(Query(GraphPattern(patterns)), _edges(spark, sf_dir))


# ---- lifetimes


def _event_catalog(spark: SparkSession, sf_dir: str, ttl: int) -> Catalog:
    ship(spark)
    df = replay(table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "event_id", "ts"), ["event_id"], "ts", ttl)
    return Catalog().add("events", Relation(df, ("user_id", "event_type", "event_id"), "seq", "ts", "expires_at", bag=True))


def _event(kind: str, user: str, event: str) -> TuplePattern:
    return TuplePattern((Var(user), Const(kind), Var(event)), "events")


_SIGNUP_BUY = Query(GraphPattern((_event("signup", "u", "a"), _event("purchase", "u", "b"))))
HOUR = 3600


def ttl_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compile_query(_SIGNUP_BUY, _event_catalog(spark, sf_dir, 6 * HOUR), meta=True)
    return out.select("u", "a", "b", "emitted_at", "expires_at")


def ttl_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite event lives joined with customers that never end."""
    found = _event_catalog(spark, sf_dir, 6 * HOUR)
    found.add("customer", Relation(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ("c_custkey", "c_mktsegment")))
    graph = GraphPattern((_event("signup", "u", "a"), _event("purchase", "u", "b"), TuplePattern((Var("u"), Var("segment")), "customer")))
    return compile_query(Query(graph), found)


def ttl_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated (user, type) tuples: lives of a day that overlap become one."""
    df = replay(table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "ts"), [], "ts", 24 * HOUR)
    found = Catalog().add("events", Relation(df, ("user_id", "event_type"), None, "ts", "expires_at"))
    graph = GraphPattern((TuplePattern((Var("u"), Const("signup")), "events"), TuplePattern((Var("u"), Const("error")), "events")))
    return compile_query(Query(graph), found, meta=True)


def query_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_query(_SIGNUP_BUY, _event_catalog(spark, sf_dir, 6 * HOUR), deadline="2024-01-10 00:00:00")


def retract_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples of user 7, and all errors, are removed by patterns with wildcards."""
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    gone = spark.createDataFrame([(7, None), (None, "error")], "user_id long, event_type string")
    left = retract(df, ["user_id", "event_type"], gone)
    found = Catalog().add("events", Relation(left, ("user_id", "event_type", "event_id")))
    return compile_query(Query(GraphPattern((TuplePattern((Var("u"), Var("t"), Var("e")), "events"),))), found)


_EV = "e AS (SELECT user_id, event_type, event_id, ts, ts + INTERVAL 6 HOUR AS x FROM events)"
_PAIR = f"WITH {_EV} SELECT a.user_id AS u, a.event_id AS a, b.event_id AS b, greatest(a.ts, b.ts) AS emitted_at, least(a.x, b.x) AS expires_at FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND greatest(a.ts, b.ts) <= least(a.x, b.x)"


# ---- Structured Streaming over the triple view


def _run_stream(spark: SparkSession, sf_dir: str, query: str, parts: list[DataFrame], static: DataFrame | None = None) -> DataFrame:
    """The answers to a stream of files that hold ``parts`` one after the other."""
    place = shared_folder(spark, "tuplewave-streams")
    for part in parts:
        part.write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema("s string, p string, o string").parquet(f"{place}/in")
    answers = stream_answers(PREFIX + query, stream, static=static)
    done = answers.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{place}/out")


def _streamed(text: str, repeats: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return _run_stream(spark, sf_dir, text, [triple_view(spark, sf_dir)] * repeats)

    return run


def stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as a stream, nations and regions as static tuples."""
    ship(spark)
    view = triple_view(spark, sf_dir)
    moving = F.col("p") == f"U{NS}inNation"
    return _run_stream(spark, sf_dir, "SELECT ?c ?r WHERE { ?c :inNation ?n . ?n :inRegion ?r }", [view.where(moving)], view.where(~moving))


def stream_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers a limited stream gives; which ones is open."""
    return _streamed("SELECT ?c WHERE { ?c :segment ?o } LIMIT 25")(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


# ---- sources and sinks


def _lines(df: DataFrame, end: str = "") -> DataFrame:
    return to_ntriples(df).select(F.regexp_replace("value", r" \.$", f"{end} .").alias("value"))


def _read_back(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The view of triples written as text and read again: as N-Triples, as N-Quads, or among lines that are none."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        place = f"{shared_folder(spark, 'tuplewave-files')}/view.{'nq' if name == 'nq' else 'nt'}"
        lines = _lines(triple_view(spark, sf_dir), f" <{NS}graph>" if name == "nq" else "")
        if name == "bad":
            lines = lines.union(lines.select(F.concat(F.lit("broken "), F.col("value")).alias("value"))).union(spark.createDataFrame([("# a comment",), ("",)], "value string"))
        lines.write.text(place)
        return read_triples(spark, place)

    return run


def read_turtle_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a small Turtle file of its own, among one that is not Turtle and is left out."""
    ship(spark)
    text = F.concat(F.lit(f"@prefix : <{NS}> . <{NS}nation/"), F.col("n_nationkey").cast("string"), F.lit('> :name "'), F.col("n_name"), F.lit(f'" ; :inRegion <{NS}region/'), F.col("n_regionkey").cast("string"), F.lit("> ."))
    place = f"{shared_folder(spark, 'tuplewave-files')}/nations"
    files = table(spark, sf_dir, "nation").select(text.alias("value")).union(spark.createDataFrame([("not [ Turtle",)], "value string"))
    files.repartition(max(files.count(), 1)).sortWithinPartitions("value").write.option("maxRecordsPerFile", 1).text(f"{place}.ttl")
    return read_triples(spark, f"{place}.ttl")


def bad_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations as relative IRIs, which are replaced."""
    ship(spark)
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("<"), F.col("n_name"), F.lit(f"> <{NS}name> <{NS}nation/"), F.col("n_nationkey").cast("string"), F.lit("> .")).alias("value"))
    return parse_lines(lines).select("s", "p", "o")


def write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return to_ntriples(triple_view(spark, sf_dir)).select(F.col("value").alias("line"))


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that an engine hands to a callback: nations pushed first, then regions' names, as two batches."""
    ship(spark)
    engine, got = StreamEngine(spark), []
    engine.add_query(INFINITE_TTL, PREFIX + "SELECT ?n ?name WHERE { ?n :inRegion ?r . ?r :name ?name }", lambda answer, _: got.append((answer["n"], answer["name"])))
    small = triple_view(spark, sf_dir).where(F.col("s").rlike("/(nation|region)/"))
    engine.add_frame(INFINITE_TTL, small.where(F.col("p") == f"U{NS}inRegion"))
    engine.add_frame(INFINITE_TTL, small.where(F.col("p") == f"U{NS}name"))
    engine.shut_down()
    return spark.createDataFrame(got, "n string, name string")


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are pushed, and what they link to is fetched from a table of documents, one for each region."""
    ship(spark)
    view = triple_view(spark, sf_dir)
    documents = view.where(F.col("s").contains("/region/")).select(F.substr("s", F.lit(2)).alias("document"), "s", "p", "o")
    engine, got = StreamEngine(spark, resolver=table_resolver(documents)), []
    engine.add_query(INFINITE_TTL, PREFIX + "SELECT ?n ?name WHERE { ?n :inRegion ?r . ?r :name ?name }", lambda answer, _: got.append((answer["n"], answer["name"])))
    engine.add_frame(INFINITE_TTL, view.where(F.col("p") == f"U{NS}inRegion"))
    engine.shut_down()
    return spark.createDataFrame(got, "n string, name string")


_ORDERED = "SELECT {} FROM (SELECT *, (epoch_us(o_orderdate), o_orderkey) AS k FROM orders) "


def _by_arrival(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        df = replay(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderdate")
        found = Catalog().add("orders", Relation(df, ("o_orderkey", "o_orderstatus", "o_custkey"), "seq", bag=True))
        found.predicate(T.iri(NS + "status"), "orders", "o_orderkey", "o_orderstatus").predicate(T.iri(NS + "placedBy"), "orders", "o_orderkey", "o_custkey")
        return compile_query(PREFIX + text, found)

    return run


def _filter(pattern: str, expr: str, names: str = "?x ?v") -> Callable[[SparkSession, str], DataFrame]:
    return sparql(f"SELECT {names} WHERE {{ {pattern} FILTER ({expr}) }}")


_NAME, _PRICE, _BAL, _DATE = "?x :partName ?v", "?x :price ?v", "?x :balance ?v", "?x :orderDate ?v"


def _sql(table_name: str, key: str, column: str, where: str) -> str:
    return f"SELECT DISTINCT {key} AS x, {column} AS v FROM {table_name} WHERE {where}"


_N = lambda w: _sql("part", "p_partkey", "p_name", w)
_P = lambda w: _sql("part", "p_partkey", "p_retailprice", w)
_B = lambda w: _sql("customer", "c_custkey", "c_acctbal", w)
_O = lambda w: _sql("orders", "o_orderkey", "o_orderdate", w)

_CHAIN = "?l :placedBy ?c . ?c :customerNation ?n . ?n :nationRegion ?r . ?r :regionName ?name"
_CYCLE = "?c :customerNation ?n . ?s :supplierNation ?n . ?o :bySupplier ?s . ?o :placedBy ?c"

#: name -> (query, SQL or None)
REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_constant": (sparql('SELECT ?o WHERE { ?o :status "F" }'), "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'"),
    "scan_wildcard": (triples("SELECT * WHERE { ?s ?p ?o }"), _T + "SELECT * FROM t"),
    "repeated_variable": (_tuples("lineitem", [Var("x"), Const("likes"), Var("x")], ["l_partkey % 50 as a", "'likes' as p", "l_suppkey % 50 as b"], bag=True), "SELECT l_partkey % 50 AS x FROM lineitem WHERE l_partkey % 50 = l_suppkey % 50"),
    "prefix_match": (_tuples("orders", [Var("o"), Var("c")]), "SELECT o_orderkey AS o, o_custkey AS c FROM orders"),
    "join_two": (sparql("SELECT ?o ?seg WHERE { ?o :placedBy ?c . ?c :segment ?seg }"), "SELECT o_orderkey AS o, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_star": (sparql("SELECT * WHERE { ?c :customerNation ?n ; :segment ?seg ; :balance ?b }"), "SELECT c_custkey AS c, c_nationkey AS n, c_mktsegment AS seg, c_acctbal AS b FROM customer"),
    "join_chain": (sparql(f"SELECT ?l ?name WHERE {{ {_CHAIN} }}"), "SELECT o_orderkey AS l, r_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "join_cycle": (sparql(f"SELECT * WHERE {{ {_CYCLE} }}"), "SELECT c_custkey AS c, c_nationkey AS n, s_suppkey AS s, o_orderkey AS o FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey"),
    "path_self_2": (_path(("x", "y"), ("y", "z")), _EDGES + "SELECT e.a AS x, e.b AS y, f.b AS z FROM e JOIN e f ON e.b = f.a"),
    "path_self_3": (_path(("x", "y"), ("y", "z"), ("z", "w")), _EDGES + "SELECT e.a AS x, e.b AS y, f.b AS z, g.b AS w FROM e JOIN e f ON e.b = f.a JOIN e g ON f.b = g.a"),
    "cycle_self_3": (_path(("x", "y"), ("y", "z"), ("z", "x")), _EDGES + "SELECT e.a AS x, e.b AS y, f.b AS z FROM e JOIN e f ON e.b = f.a JOIN e g ON f.b = g.a AND g.b = e.a"),
    "redundant_patterns": (sparql("SELECT ?c ?n WHERE { ?c :customerNation ?n . ?c :customerNation ?n }"), "SELECT c_custkey AS c, c_nationkey AS n FROM customer"),
    "projection_rename": (sparql("SELECT (?c AS ?person) (?n AS ?place) WHERE { ?c :customerNation ?n }"), "SELECT c_custkey AS person, c_nationkey AS place FROM customer"),
    "projection_constant": (sparql('SELECT ?c ("yes" AS ?known) WHERE { ?c :segment "BUILDING" }'), f"SELECT c_custkey AS c, {_lit(T.STRING, repr('yes'))} AS known FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "unselected_vars": (sparql("SELECT ?n WHERE { ?c :customerNation ?n . ?c :balance ?b }"), "SELECT c_nationkey AS n FROM customer"),
    "select_star": (sparql("SELECT * WHERE { ?n :nationName ?name . ?n :nationRegion ?r }"), "SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation"),
    "distinct": (sparql("SELECT DISTINCT ?n ?seg WHERE { ?c :customerNation ?n . ?c :segment ?seg }"), "SELECT DISTINCT c_nationkey AS n, c_mktsegment AS seg FROM customer"),
    "reduced": (sparql("SELECT REDUCED ?seg WHERE { ?c :segment ?seg }"), "SELECT DISTINCT c_mktsegment AS seg FROM customer"),
    "limit_by_arrival": (_by_arrival("SELECT ?o ?s WHERE { ?o :status ?s } LIMIT 25"), _ORDERED.format("o_orderkey AS o, o_orderstatus AS s") + "ORDER BY k LIMIT 25"),
    "limit_offset": (_by_arrival('SELECT ?o ?c WHERE { ?o :status "O" . ?o :placedBy ?c } LIMIT 20 OFFSET 30'), _ORDERED.format("o_orderkey AS o, o_custkey AS c") + "WHERE o_orderstatus = 'O' ORDER BY k LIMIT 20 OFFSET 30"),
    "offset_by_arrival": (_by_arrival('SELECT ?o WHERE { ?o :status "P" } OFFSET 10'), _ORDERED.format("o_orderkey AS o") + "WHERE o_orderstatus = 'P' ORDER BY k OFFSET 10"),
    "ask_true": (sparql('ASK { ?c :segment "BUILDING" }'), "SELECT true AS answer FROM customer WHERE c_mktsegment = 'BUILDING' LIMIT 1"),
    "ask_false": (sparql('ASK { ?c :segment "NONE" }'), "SELECT true AS answer FROM customer WHERE c_mktsegment = 'NONE' LIMIT 1"),
    "construct": (triples("CONSTRUCT { ?c :livesIn ?r } WHERE { ?c :inNation ?n . ?n :inRegion ?r }"), _T + f"SELECT DISTINCT a.s AS subject, 'U{NS}livesIn' AS predicate, b.o AS object FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'U{NS}inNation' AND b.p = 'U{NS}inRegion'"),
    "filter_regex": (_filter(_NAME, 'regex(?v, "a.*e", "i")'), _N("regexp_matches(p_name, '(?i)a.*e')")),
    "filter_starts": (_filter(_NAME, 'strstarts(?v, "b") || strends(?v, "ng")'), _N("starts_with(p_name, 'b') OR suffix(p_name, 'ng')")),
    "filter_contains": (_filter(_NAME, 'contains(lcase(?v), "re")'), _N("contains(lower(p_name), 're')")),
    "filter_strlen": (_filter(_NAME, "strlen(?v) > 9"), _N("length(p_name) > 9")),
    "filter_substr": (_filter(_NAME, 'substr(?v, 2, 1) = "a"'), _N("substr(p_name, 2, 1) = 'a'")),
    "filter_ucase": (_filter(_NAME, 'ucase(?v) < "M"'), _N("upper(p_name) < 'M'")),
    "filter_replace": (_filter(_NAME, 'strlen(replace(?v, "[aeiou]", "")) < 6'), _N("length(regexp_replace(p_name, '[aeiou]', '', 'g')) < 6")),
    "filter_strbefore": (_filter(_NAME, 'strbefore(?v, " ") != ""'), _N("contains(p_name, ' ') AND split_part(p_name, ' ', 1) <> ''")),
    "filter_strafter": (_filter(_NAME, 'strlen(strafter(?v, "a")) > 4'), _N("contains(p_name, 'a') AND length(substr(p_name, instr(p_name, 'a') + 1)) > 4")),
    "filter_concat": (_filter(_NAME, 'contains(concat(?v, "-", ?v), "t-b") || strstarts(concat("x", ?v), "xs")'), _N("contains(p_name || '-' || p_name, 't-b') OR starts_with('x' || p_name, 'xs')")),
    "filter_numeric": (_filter(_PRICE, "?v >= 920 && ?v < 950.5"), _P("p_retailprice >= 920 AND p_retailprice < 950.5")),
    "filter_ceil": (_filter(_PRICE, "ceil(?v) = 1000 || floor(?v) = 911"), _P("ceil(p_retailprice) = 1000 OR floor(p_retailprice) = 911")),
    "filter_round": (_filter(_BAL, "round(?v / 100) = 12"), _B("floor(c_acctbal / 100 + 0.5) = 12")),
    "filter_abs": (_filter(_BAL, "abs(?v) < 500"), _B("abs(c_acctbal) < 500")),
    "filter_arith": (_filter(_BAL, "(?v + 10) * 2 - 5 > 9000"), _B("(c_acctbal + 10) * 2 - 5 > 9000")),
    "filter_in": (_filter("?x :segment ?v", '?v IN ("BUILDING", "MACHINERY")'), _sql("customer", "c_custkey", "c_mktsegment", "c_mktsegment IN ('BUILDING', 'MACHINERY')")),
    "filter_not_in": (_filter("?x :segment ?v", '?v NOT IN ("BUILDING", "MACHINERY")'), _sql("customer", "c_custkey", "c_mktsegment", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")),
    "filter_logic": (_filter("?x :segment ?v", '!(?v = "BUILDING") && ?v != "FURNITURE"'), _sql("customer", "c_custkey", "c_mktsegment", "c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")),
    "filter_if": (_filter(_BAL, "if(?v < 0, -?v, ?v) > 9000"), _B("abs(c_acctbal) > 9000")),
    "filter_year": (_filter(_DATE, "year(?v) = 1995"), _O("year(o_orderdate) = 1995")),
    "filter_month_day": (_filter(_DATE, "month(?v) = 3 && day(?v) <= 10"), _O("month(o_orderdate) = 3 AND day(o_orderdate) <= 10")),
    "filter_hours": (_filter("?x :eventTime ?v", "hours(?v) = 13 && minutes(?v) < 30"), _sql("events", "event_id", "ts", "hour(ts) = 13 AND minute(ts) < 30")),
    "filter_md5": (_filter("?x :nationName ?v", 'strstarts(md5(?v), "a") || strends(sha1(?v), "0") || contains(sha256(?v), "abc")'), _sql("nation", "n_nationkey", "n_name", "starts_with(md5(n_name), 'a') OR suffix(sha1(n_name), '0') OR contains(sha256(n_name), 'abc')")),
    "filter_isliteral": (triples("SELECT ?s ?o WHERE { ?s ?p ?o FILTER (isLiteral(?o) && !isNumeric(?o)) }"), _T + f"SELECT s, o FROM t WHERE o LIKE 'L%' AND p <> 'U{NS}key'"),
    "filter_isiri": (triples("SELECT ?s ?o WHERE { ?s ?p ?o FILTER (isIRI(?o)) }"), _T + "SELECT s, o FROM t WHERE o LIKE 'U%'"),
    "filter_datatype": (triples("SELECT ?s ?o WHERE { ?s ?p ?o FILTER (datatype(?o) = xsd:integer && ?o < 20) }"), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}key' AND split_part(o, chr(1), 3)::BIGINT < 20"),
    "filter_lang": (triples('SELECT ?s ?o WHERE { ?s :segment ?o FILTER (langMatches(lang(?o), "EN") && str(?o) = "BUILDING") }'), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}segment' AND o LIKE '%BUILDING'"),
    "filter_sameterm": (triples("SELECT ?a ?b WHERE { ?a :inRegion ?r . ?b :inRegion ?r FILTER (!sameTerm(?a, ?b)) }"), _T + f"SELECT a.s AS a, b.s AS b FROM t a JOIN t b ON a.o = b.o AND a.p = b.p WHERE a.p = 'U{NS}inRegion' AND a.s <> b.s"),
    "filter_theta": (sparql("SELECT ?a ?b WHERE { ?a :nationRegion ?r . ?b :nationRegion ?r . ?a :nationName ?x . ?b :nationName ?y FILTER (?x < ?y) }"), "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_name < b.n_name"),
    "filter_error": (triples("SELECT ?s ?o WHERE { ?s ?p ?o FILTER (?o > 5) }"), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}key' AND split_part(o, chr(1), 3)::BIGINT > 5"),
    "filter_seconds": (_filter("?x :eventTime ?v", "seconds(?v) < 10 && tz(?v) = ''"), _sql("events", "event_id", "ts", "second(ts) < 10")),
    "filter_bound": (_filter(_BAL, 'bound(?v) && coalesce(?none, ?v) > 9000'), _B("c_acctbal > 9000")),
    "filter_isblank": (triples("SELECT ?s ?o WHERE { ?s :inRegion ?o FILTER (!isBlank(?o) && isBlank(bnode()) && isBlank(bnode(str(?o)))) }"), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}inRegion'"),
    "filter_iri": (triples(f'SELECT ?s ?o WHERE {{ ?s :inRegion ?o FILTER (?o = iri(concat("{NS}region/", "1")) && isIRI(uri(str(?o)))) }}'), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}inRegion' AND o = 'U{NS}region/1'"),
    "filter_strdt": (triples('SELECT ?s ?o WHERE { ?s :key ?o FILTER (strdt(str(?o), xsd:integer) = ?o && datatype(strdt("5", xsd:byte)) = xsd:byte && ?o < 30) }'), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}key' AND split_part(o, chr(1), 3)::BIGINT < 30"),
    "filter_strlang": (triples('SELECT ?s ?o WHERE { ?s :segment ?o FILTER (?o = strlang("MACHINERY", "en")) }'), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}segment' AND o LIKE '%MACHINERY'"),
    "filter_language_kept": (triples('SELECT ?s ?o WHERE { ?s :segment ?o FILTER (lang(lcase(?o)) = "en" && lcase(?o) = "building"@en && substr(?o, 1, 3) = "BUI"@en) }'), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}segment' AND o LIKE '%BUILDING'"),
    "filter_uuid": (_filter(_BAL, 'isIRI(uuid()) && strlen(struuid()) = 36 && uuid() != uuid() && ?v > 5000'), _B("c_acctbal > 5000")),
    "filter_encode": (_filter(_NAME, 'contains(encode_for_uri(?v), "%20b")'), _N("contains(p_name, ' b')")),
    "filter_rand_now": (_filter(_BAL, "rand() >= 0 && rand() < 1 && year(now()) > 2000 && ?v < 0"), _B("c_acctbal < 0")),
    "filter_sha512": (_filter("?x :nationName ?v", 'strlen(sha512(?v)) = 128 && strlen(sha384(?v)) = 96 && sha384(?v) != sha512(?v)'), _sql("nation", "n_nationkey", "n_name", "true")),
    "filter_cast_number": (triples("SELECT ?s ?o WHERE { ?s :key ?o FILTER (xsd:integer(?o) = 12 || xsd:decimal(str(?o)) = 13.0 || xsd:double(?o) = 1.4e1 || xsd:float(?o) = 15) }"), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}key' AND split_part(o, chr(1), 3)::BIGINT BETWEEN 12 AND 15"),
    "filter_cast_other": (triples('SELECT ?s ?o WHERE { ?s :key ?o FILTER (xsd:string(?o) = "17" || (xsd:boolean(?o) = false && ?o < 5) || xsd:dateTime(concat("2020-01-0", str(?o), "T00:00:00Z")) > "2020-01-07T00:00:00Z"^^xsd:dateTime) }'), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}key' AND split_part(o, chr(1), 3)::BIGINT IN (0, 8, 9, 17)"),
    "filter_exact": (triples("SELECT ?s ?o WHERE { ?s :key ?o FILTER (?o * 0 = 0 && 9007199254740993 != 9007199254740992 && datatype(7 / 2) = xsd:decimal && 0.1 + 0.2 = 0.3 && ?o <= 40) }"), _T + f"SELECT s, o FROM t WHERE p = 'U{NS}key' AND split_part(o, chr(1), 3)::BIGINT <= 40"),
    "source_ntriples": (_read_back("nt"), _T + "SELECT * FROM t"),
    "source_nquads": (_read_back("nq"), _T + "SELECT * FROM t"),
    "source_bad_lines": (_read_back("bad"), _T + "SELECT * FROM t"),
    "source_turtle": (read_turtle_file, _T + "SELECT * FROM t WHERE s LIKE '%/nation/%'"),
    "source_bad_iri": (bad_iri, f"SELECT 'U{BAD_IRI}' AS s, 'U{NS}name' AS p, 'U{NS}nation/' || n_nationkey AS o FROM nation"),
    "source_linked": (linked, _T + f"SELECT a.s AS n, b.o AS name FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'U{NS}inRegion' AND b.p = 'U{NS}name'"),
    "sink_callback": (pushed, _T + f"SELECT a.s AS n, b.o AS name FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'U{NS}inRegion' AND b.p = 'U{NS}name'"),
    "sink_ntriples": (write_lines, _T + """, w AS (SELECT s, p, o, split_part(substr(o, 2), chr(1), 1) AS d, split_part(o, chr(1), 2) AS l, split_part(o, chr(1), 3) AS x FROM t)
SELECT '<' || substr(s, 2) || '> <' || substr(p, 2) || '> ' || CASE WHEN o LIKE 'U%' THEN '<' || substr(o, 2) || '>' WHEN l <> '' THEN '"' || x || '"@' || l WHEN d LIKE '%#string' THEN '"' || x || '"' ELSE '"' || x || '"^^<' || d || '>' END || ' .' AS line FROM w"""),
    "ttl_join_finite": (ttl_join, _PAIR),
    "ttl_join_static": (ttl_static, f"WITH q AS ({_PAIR}) SELECT u, a, b, c_mktsegment AS segment FROM q JOIN customer ON u = c_custkey"),
    "ttl_supersede": (ttl_supersede, """WITH d AS (SELECT DISTINCT user_id, event_type, ts FROM events WHERE event_type IN ('signup', 'error')),
m AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 24 HOUR, true) AS n FROM d WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
g AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM m),
l AS (SELECT user_id, event_type, min(ts) AS a, max(ts) + INTERVAL 24 HOUR AS x FROM g GROUP BY user_id, event_type, k)
SELECT p.user_id AS u, greatest(p.a, q.a) AS emitted_at, least(p.x, q.x) AS expires_at FROM l p JOIN l q USING (user_id) WHERE p.event_type = 'signup' AND q.event_type = 'error' AND greatest(p.a, q.a) <= least(p.x, q.x)"""),
    "query_deadline": (query_deadline, f"WITH q AS ({_PAIR}) SELECT u, a, b FROM q WHERE emitted_at <= TIMESTAMP '2024-01-10 00:00:00'"),
    "retract_pattern": (retract_pattern, "SELECT user_id AS u, event_type AS t, event_id AS e FROM events WHERE user_id <> 7 AND event_type <> 'error'"),
    "stream_join": (_streamed("SELECT ?c ?r WHERE { ?c :inNation ?n . ?n :inRegion ?r }"), _T + f"SELECT a.s AS c, b.o AS r FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'U{NS}inNation' AND b.p = 'U{NS}inRegion'"),
    "stream_static": (stream_static, _T + f"SELECT a.s AS c, b.o AS r FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'U{NS}inNation' AND b.p = 'U{NS}inRegion'"),
    "stream_duplicates": (_streamed("SELECT ?c ?r WHERE { ?c :inNation ?n . ?n :inRegion ?r }", repeats=2), _T + f"SELECT a.s AS c, b.o AS r FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'U{NS}inNation' AND b.p = 'U{NS}inRegion'"),
    "stream_limit": (stream_limit, "SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 25)"),
    "stream_distinct": (_streamed("SELECT DISTINCT ?o WHERE { ?c :segment ?o }"), _T + f"SELECT DISTINCT o FROM t WHERE p = 'U{NS}segment'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
