"""Linked Data: statements about resources, fetched when a query or a matched tuple names them.

A resolver maps a frame with the column ``iri`` to ``s``, ``p``, ``o``. ``table_resolver`` answers from a table of documents,
``http_resolver`` fetches Turtle or N-Triples from where the IRIs lead. Only ``http`` and ``https`` IRIs are followed, each
once; what cannot be fetched or parsed is logged and gives no statements.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.algebra import Const, Query

Resolver = Callable[[DataFrame], DataFrame]


def table_resolver(documents: DataFrame, key: str = "document") -> Resolver:
    return lambda iris: documents.join(iris, documents[key] == iris["iri"], "left_semi").select("s", "p", "o")


#: What is asked for, and the largest document that is taken.
ACCEPT, LARGEST = "text/turtle, application/n-triples;q=0.9", 64 << 20


def fetch(url: str, timeout: float = 20.0) -> str:
    """The document at ``url`` as text."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"Accept": ACCEPT}), timeout=timeout) as answer:
        data = answer.read(LARGEST + 1)
        if len(data) > LARGEST:
            raise OSError(f"{url} is larger than {LARGEST} bytes")
        return data.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def http_resolver(get: Callable[[str], str] = fetch, parallel: int = 8) -> Resolver:
    """Fetches side by side in at most ``parallel`` tasks; IRIs that differ in their fragments alone share a document."""
    from .rdf import parse_turtle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                try:
                    found = parse_turtle(get(url), url)  # N-Triples are Turtle
                except (OSError, ValueError) as error:
                    logging.getLogger(__name__).warning("%s gives no statements: %s", url, error)
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in found], pa.string()) for i in range(3)], names=["s", "p", "o"])

    def resolve(iris: DataFrame) -> DataFrame:
        urls = iris.select(F.substring_index("iri", "#", 1).alias("url")).distinct().repartition(parallel, "url")
        return urls.mapInArrow(run, "s string, p string, o string")

    return resolve


def web_iri(term):
    return term.rlike(r"^Uhttps?://")


def seeds(spark: SparkSession, query: Query) -> DataFrame:
    """Constant IRIs at the subject and object positions of a query's patterns."""
    found = {t.value for p in query.graph.patterns for t in (p.terms[0], p.terms[-1]) if isinstance(t, Const) and isinstance(t.value, str)}
    return spark.createDataFrame([(t[1:],) for t in sorted(found) if t.startswith(("Uhttp://", "Uhttps://"))], "iri string")


def frontier(tuples: DataFrame) -> DataFrame:
    """Subjects and objects of tuples of which both are IRIs."""
    both = tuples.where(T.is_iri(F.col("s")) & T.is_iri(F.col("o")))
    ends = both.select(F.explode(F.array("s", "o")).alias("t")).where(web_iri(F.col("t")))
    return ends.select(F.substr("t", F.lit(2)).alias("iri")).distinct()


def expand(resolver: Resolver, wanted: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Statements about the wanted resources that are not known yet, and all that are known then."""
    new = wanted.distinct() if known is None else wanted.distinct().join(known, "iri", "left_anti")
    return resolver(new), new if known is None else known.union(new)
