"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into blocks and a segment is a choice of blocks. Over b blocks, d differing bits leave b - d
blocks intact and one more with a single differing bit at most, so some choice of b - d + 1 blocks differs by at
most one bit. By default there are as many blocks as differing bits and a segment is one block: two halves for two bits,
which makes 64 variants of each fingerprint. Every segment is indexed with each of its bits wildcarded in turn, and an equality join on
(segment, wildcard, remaining bits) finds each pair. Within a key
the pairs are verified by counting differing bits and reduced to a spanning forest, so a group of n fingerprints
gives at most n - 1 links and a key never holds more than the values of its free bits.

Nulls: a null text counts as empty and has fingerprint zero; a null id takes part but never names a class unless all
ids of the class are null. Repeated rows share their class. Empty tables give empty results. Only the id and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, materialize, ready
from .components import connected_components

BITS = 64
#: A search in a sorted group takes the time of about so many comparisons of fingerprints.
SEARCH_COST = 50


def simhash_text(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Reference form for one text."""
    return int(_fingerprints([text], shingle, seed)[0])


def _fingerprints(texts: list[str | None], shingle: int, seed: int) -> np.ndarray:
    hash64 = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(shingle, len(words))
        spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
        hashes = np.array([hash64(joined[a:b], seed) for a, b in spans], np.uint64)
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 65536):
            part = hashes[at : at + 65536]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = (2 * counts > len(hashes)).astype(np.uint8)
        out[row] = np.packbits(bits, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Id and the fingerprint as a signed long."""
    ready(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            prints = [_fingerprints(texts.slice(at, 256).to_pylist(), shingle, seed) for at in range(0, len(texts), 256)]
            found = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).alias(id_col), blank(F.col(text_col)).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def segments(distance: int, blocks: int) -> list[int]:
    """Bit masks: for any ``distance`` differing bits, one of the masks covers at most one of them.

    The blocks with the fewest differing bits: with d bits over b blocks, b - d blocks have none and one more has
    at most one, so choosing b - d + 1 blocks always leaves a choice with at most one differing bit.
    """
    take = blocks - distance + 1
    if take < 1 or distance < 1:
        raise ValueError("at least as many blocks as differing bits are needed, and one of these")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), take)]


def _flips(free: np.ndarray, most: int) -> np.ndarray:
    """All masks over the given bits with at most ``most`` set."""
    out = [0]
    for k in range(1, most + 1):
        out += [int(sum(1 << int(b) for b in c)) for c in combinations(free, k)]
    return np.array(out, np.uint64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(values: np.ndarray, mask: int, wild: int, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among ``values`` (sorted, distinct, equal on ``mask`` but for ``wild``).

    Each value leaves the search once it is reached, so a group whose values are all close to each other costs about
    one comparison a value and is never expanded into its pairs.
    """
    n = len(values)
    free = np.array([b for b in range(BITS) if not mask >> b & 1 or b == wild])
    masks = sum(comb(len(free), k) for k in range(distance + 1))
    if n > SEARCH_COST * masks:
        return _forest_by_lookup(values, _flips(free, distance))
    links, rest, left = [], np.arange(n), values
    while len(rest):
        queue, rest, left = [int(rest[0])], rest[1:], left[1:]
        while queue and len(rest):
            i = queue.pop()
            near = _popcount(left ^ values[i]) <= distance
            if near.any():
                reached = rest[near].tolist()
                links += [(i, j) for j in reached]
                queue += reached
                rest, left = rest[~near], left[~near]
    return links


def _forest_by_lookup(values: np.ndarray, flips: np.ndarray) -> list[tuple[int, int]]:
    """The same by searching each neighbour that the free bits allow, whose number does not grow with the group."""
    n = len(values)
    links, seen = [], np.zeros(n, bool)
    for root in range(n):
        queue = [] if seen[root] else [root]
        seen[root] = True
        while queue:
            i = queue.pop()
            near = values[i] ^ flips
            at = np.minimum(np.searchsorted(values, near), n - 1)
            reached = at[(values[at] == near) & ~seen[at]]
            seen[reached] = True
            links += [(i, j) for j in reached.tolist()]
            queue += reached.tolist()
    return links


def links(distinct: DataFrame, distance: int = 2, blocks: int | None = None) -> DataFrame:
    """``src``, ``dst``: enough links between fingerprints at ``distance`` or less to connect all that are linked."""
    ready(distinct)
    masks = segments(distance, blocks or distance)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    variants = [(i, bit, signed(mask & ~(1 << bit))) for i, mask in enumerate(masks) for bit in range(BITS) if mask >> bit & 1]
    table = F.array(*[F.struct(F.lit(i * BITS + bit).alias("v"), F.lit(m).cast("long").alias("m")) for i, bit, m in variants])
    keyed = distinct.select("fp", F.explode(table).alias("x")).select(F.col("x.v").alias("v"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    spread = keyed.repartition(F.col("key"), F.col("v")).sortWithinPartitions("key", "v", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the last key so far

        def scan(v: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (v[1:] != v[:-1]), [True])))
            src, dst = [], []
            for g in np.flatnonzero(np.diff(cut) > 1):
                a, b = cut[g], cut[g + 1]
                values = np.unique(fp[a:b].view(np.uint64))
                which, wild = divmod(int(v[a]), BITS)
                for i, j in _forest(values, masks[which], wild, distance):
                    src.append(values[i])
                    dst.append(values[j])
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)], names=["src", "dst"])

        for batch in batches:
            v, key, fp = new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(v):
                continue
            if held and (key[-1] != held[0][1][0] or v[-1] != held[0][0][0]):
                new = [np.concatenate(x) for x in zip(*held, new, strict=True)]
                held = []
            elif held:
                held.append(new)
                continue
            v, key, fp = new
            last = int(np.flatnonzero((key == key[-1]) & (v == v[-1]))[0])
            if last:
                yield scan(v[:last], key[:last], fp[:last])
            held = [[x[last:] for x in new]]
        if held:
            yield scan(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return spread.select(F.col("v").cast("int").alias("v"), "key", "fp").mapInArrow(run, "src bigint, dst bigint").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, blocks: int | None = None, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Id, ``fp`` (signed long) and ``component_id``: the smallest id that is reachable over links."""
    ready(docs)
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp")
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    found = materialize(links(distinct.select("fp"), distance, blocks), "simhash-links")
    member = connected_components(found)
    grouped = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(best, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
