"""``python -m tuplewave.cli queries.txt data.txt [--verbose]``: register the listed queries, then stream the listed files."""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.terms import ntriples
from .sources.rdf import read_triples
from .streaming.engine import INFINITE_TTL, StreamEngine


def _listed(path: str) -> list[str]:
    here = Path(path).parent
    lines = [x.strip() for x in Path(path).read_text().splitlines()]
    return [x if "://" in x or x.startswith("/") else str(here / x) for x in lines if x and not x.startswith("#")]


def run(spark: SparkSession, queries: str, data: str, out=print, verbose: bool = False) -> StreamEngine:
    engine = StreamEngine(spark, log=out if verbose else None)
    for path in _listed(queries):
        def show(answer: dict, expiry: float | None, path: str = path) -> None:
            values = "\t".join(f"{k}={ntriples(v)}" for k, v in answer.items() if v is not None)
            out(f"RESULT\t{time.time():.3f}\t{path}\t{values}")

        engine.add_query(INFINITE_TTL, Path(path).read_text(), show)
    for path in _listed(data):
        engine.add_frame(INFINITE_TTL, read_triples(spark, path))
    return engine


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    if len(args) != 2:
        sys.exit(__doc__)
    run(SparkSession.builder.getOrCreate(), *args, verbose="--verbose" in sys.argv)


if __name__ == "__main__":
    main()
