"""Readers of RDF: N-Triples and N-Quads natively and line by line, Turtle by a small parser on the driver."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.algebra import Const, IncompatibleQueryError, InvalidQueryError, Var
from ..plans.sparql import Parser

#: Fixed value: what stands for an IRI that is not one.
BAD_IRI = "http://example.org/substitute-for-bad-iri"
_IRI, _BLANK = r"<([^>]*)>", r"_:([^\s<>\"]+)"
_LITERAL = r"\"((?:[^\"\\]|\\.)*)\"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?"
_LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:{_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


def _unescape(text: Column) -> Column:
    r"""Decode ``\t \n \r \b \f \" \' \\ \uXXXX \UXXXXXXXX``; texts without a backslash are left as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def one(x: Column) -> Column:
        code = F.conv(F.substr(x, F.lit(3)), 16, 10).cast("long")
        # A code point as UTF-8 is decoded from its UTF-32 bytes.
        point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        simple = F.element_at(F.create_map(*[F.lit(c) for p in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f")) for c in p]), F.substr(x, F.lit(2)))
        return F.when(x.rlike(r"^\\[uU]"), point).when(x.startswith("\\"), F.coalesce(simple, F.substr(x, F.lit(2)))).otherwise(x)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _iri(text: Column) -> Column:
    """Relative or malformed IRIs are replaced, not refused."""
    return F.concat(F.lit("U"), F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>\"{}|^`]*$"), text).otherwise(BAD_IRI))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``s``, ``p``, ``o``, ``bad``: statements of N-Triples or N-Quads lines; graphs are dropped.

    ``bad`` rows have null terms; comments and empty lines are left out.
    """
    text = F.col(column)
    group = lambda i: F.regexp_extract(text, _LINE, i)
    df = lines.where(~text.rlike(r"^\s*(#.*)?$")).select(text.rlike(_LINE).alias("ok"), *[group(i).alias(f"g{i}") for i in range(1, 9)], F.regexp_extract(text, rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(.)", 4).alias("lead"))
    g = lambda i: F.col(f"g{i}")
    node = lambda a, b: F.when(b != "", F.concat(F.lit("B"), b)).otherwise(_iri(_unescape(a)))
    kind = F.when(g(7) != "", T.LANG_STRING).when(g(8) != "", _unescape(g(8))).otherwise(T.STRING)
    lit = F.concat(F.lit("L"), kind, F.lit(T.CUT), F.lower(g(7)), F.lit(T.CUT), _unescape(g(6)))
    term = F.when(F.col("lead") == '"', lit).otherwise(node(g(4), g(5)))
    ok = F.col("ok")
    return df.select(F.when(ok, node(g(1), g(2))).alias("s"), F.when(ok, _iri(_unescape(g(3)))).alias("p"), F.when(ok, term).alias("o"), (~ok).alias("bad"))


def read_ntriples(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Statements of N-Triples or N-Quads files; bad lines are skipped, or with ``tolerant=False`` fail the job."""
    parsed = parse_lines(spark.read.text(path))
    if tolerant:
        return parsed.where("not bad").drop("bad")
    return parsed.where(F.when(F.col("bad"), F.raise_error(F.lit("bad statement"))).otherwise(F.lit(True)).cast("boolean")).drop("bad")


def stream_ntriples(spark: SparkSession, path: str, ttl_seconds: int = 0, **options) -> DataFrame:
    """The same from files that keep arriving, with arrival and expiry."""
    lines = spark.readStream.options(**options).text(path)
    df = parse_lines(lines.withColumn("arrival", F.current_timestamp()).select("value"), "value").where("not bad").drop("bad")
    df = df.withColumn("arrival", F.current_timestamp())
    return df.withColumn("expires_at", F.col("arrival") + F.expr(f"interval {ttl_seconds} seconds") if ttl_seconds else F.lit(None).cast("timestamp"))


class _Turtle(Parser):
    """Turtle shares its tokens, nodes and property lists with query patterns; blank nodes become labels."""

    def document(self) -> list[tuple[str, str, str]]:
        out: list = []
        while self.kind != "end":
            if self.is_word("PREFIX", "BASE") or (self.kind == "lang" and self.text in ("@prefix", "@base")):
                at, what = self.text.startswith("@"), self.take().lstrip("@").upper()
                if what == "BASE":
                    self.base = urljoin(self.base, self.iri_ref())
                else:
                    name = self.take()[:-1]
                    self.prefixes[name] = self.iri_ref()
                if at:
                    self.need(".")
                continue
            subject = self.node(out)
            if not self.is_sign("."):
                self.properties(subject, out)
            self.need(".")
        term = lambda t: t.value if isinstance(t, Const) else T.blank_node(t.name.removeprefix("__blank_"))
        for p in out:
            if any(isinstance(t, Var) and t.name not in self.hidden for t in p.terms):
                raise InvalidQueryError("a variable in Turtle")
        return [tuple(map(term, p.terms)) for p in out]


def parse_turtle(text: str, base: str | None = None) -> list[tuple[str, str, str]]:
    parser = _Turtle(text)
    parser.base = base or parser.base
    return parser.document()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Small Turtle files: the format has no line structure, so each file is parsed as a whole, one file for a row.

    A file that is not Turtle is logged by its task and left out; the others are read.
    """
    def run(rows):
        import logging

        import pyarrow as pa

        for batch in rows:
            found = []
            for text in batch.column(0).to_pylist():
                try:
                    found += parse_turtle(text)
                except (InvalidQueryError, IncompatibleQueryError) as error:
                    logging.getLogger(__name__).warning("a file is not Turtle: %s; it begins %r", error, text[:60])
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in found], pa.string()) for i in range(3)], names=["s", "p", "o"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "s string, p string, o string")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """By file extension: .nt, .nq, .ttl, or Parquet with the columns s, p, o."""
    end = re.sub(r"\.(gz|bz2)$", "", path.lower()).rsplit(".", 1)[-1]
    if end in ("nt", "nq"):
        return read_ntriples(spark, path)
    if end in ("ttl", "turtle"):
        return read_turtle(spark, path)
    return spark.read.parquet(path).select("s", "p", "o")


def statements(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Terms already encoded, for tests and small static data."""
    return spark.createDataFrame(rows, "s string, p string, o string")


def to_ntriples(df: DataFrame) -> DataFrame:
    """One line for each statement, to be written as text."""
    def show(t: Column) -> Column:
        text = T.lexical(t)
        for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(raw), F.lit(shown))
        kind = F.when(T.language(t) != "", F.concat(F.lit("@"), T.language(t))).when(T.datatype(t) == T.STRING, "").otherwise(F.concat(F.lit("^^<"), T.datatype(t), F.lit(">")))
        return F.when(T.is_iri(t), F.concat(F.lit("<"), F.substr(t, F.lit(2)), F.lit(">"))).when(T.is_blank(t), F.concat(F.lit("_:"), F.substr(t, F.lit(2)))).otherwise(F.concat(F.lit('"'), text, F.lit('"'), kind))

    return df.select(F.concat_ws(" ", show(F.col("s")), show(F.col("p")), show(F.col("o")), F.lit(".")).alias("value"))
