"""Removal of repeated byte strings with a run-length index.

Every string of ``length`` bytes belongs to the piece of text around its minimizer: the least hash of its 64-byte
substrings, leftmost of equals. Equal strings have equal minimizers, so pieces are dealt to shards by that
hash and a shard decides for all of its strings; pieces whose minimizer occurs once cannot repeat, and pieces of
equal content repeat as a whole. The different pieces of a shared minimizer go to the run-length index of their
shard (``run_index``). A minimizer whose pieces are more than one index takes is divided by a longer one: its pieces are
cut anew by the least hash of longer substrings, again and again if need be. At the last step the substring is the whole
string, which leaves one content for each hash, so every minimizer is divided far enough, however often it occurs.

Contents are told apart by 128 bits of hash (and that of their minimizer). Nulls: a null text is empty. Null and repeated
ids are handled by a key of their own, and equal texts of two rows repeat whatever their ids are. Texts shorter than
``length`` lose nothing. Empty tables give empty results. All columns pass through; the added one takes a name that none
of them has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, ready, splitmix, text_slices
from .keys import free_name, keyed, with_field
from .run_index import RunIndex

LENGTH = 200
GRAM = 64
#: Bytes of text in one index; bytes of different pieces of one minimizer, beyond which it is divided.
SHARD_BYTES, CROWDED_BYTES = 1 << 20, 1 << 15
_BLOCK = 1 << 16


def gram_sizes(length: int) -> list[int]:
    """Bytes of the minimizers of each step, up to the whole string."""
    sizes = [min(GRAM, length)]
    while sizes[-1] < length:
        sizes.append(length - (length - sizes[-1]) // 2)
    return sizes


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` bytes, by doubling; the last step lets two halves overlap."""
    h, width = _TABLE[data], 1
    while width < gram:
        step = min(width, gram - width)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[step:]
        width += step
    return splitmix(h ^ np.uint64(gram * 0xD6E8FEB86659FD95 & (1 << 64) - 1))


_TABLE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start in the slice, strings, minimizer hash): runs of strings with one minimizer."""
    total = len(data)
    texts, starts, sizes, hashes = [], [], [], []
    room = np.diff(offsets)
    if total < length or not (room >= length).any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    width = length - gram + 1
    low = np.uint64((1 << 18) - 1)
    for at in range(0, total - length + 1, _BLOCK):
        part = data[at : at + _BLOCK + length - 1]
        h = _gram_hashes(part, gram)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        owner = (least & low).astype(np.int64)
        here = np.arange(at, at + len(owner))
        text = np.searchsorted(offsets, here, side="right") - 1
        inside = here + length <= offsets[text + 1]
        mark = np.where(inside, owner, -1)
        cut = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))))
        size = np.diff(np.concatenate((cut, [len(mark)])))
        good = inside[cut]
        cut, size = cut[good], size[good]
        texts.append(text[cut])
        starts.append(here[cut])
        sizes.append(size)
        hashes.append(h[owner[cut]])
    return np.concatenate(texts), np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)


def _content(view: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of each content's hash."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _occurrences(rows: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """key, copies, start, n, v, g, h of every piece of ``rows`` (key, copies, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_slices(batch, "text", 1 << 20):
                text, start, n, v = pieces(data, offsets, length, gram)
                content = _content(memoryview(data), start, start + n + length - 1)
                of = pa.array(text + row)
                cols = [batch.column(0).take(of), batch.column(1).take(of), pa.array(start - offsets[text]), pa.array(n), pa.array(v.view(np.int64)), pa.array(content[:, 0]), pa.array(content[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "copies", "start", "n", "v", "g", "h"])

    return rows.mapInArrow(run, f"key {kind}, copies bigint, start bigint, n bigint, v bigint, g bigint, h bigint")


def _content_rows(found: DataFrame, length: int) -> DataFrame:
    """v, g, h, copies, content of the pieces listed in ``open`` for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(0)[row].as_py()
                data = data.encode() if isinstance(data, str) else data
                todo, copies = batch.column(2)[row].as_py(), batch.column(1)[row].as_py()
                cols = [[x[c] for x in todo] for c in "vgh"] + [[copies] * len(todo), [data[x["start"] : x["start"] + x["n"] + length - 1] for x in todo]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["v", "g", "h", "copies", "content"])

    return found.select("text", "copies", "open").mapInArrow(run, "v bigint, g bigint, h bigint, copies bigint, content binary")


def _indexed(content: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """v, g, h, [a, b): the strings of each piece that repeat, from the run-length index of their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def decide() -> pa.RecordBatch:
            out: list[tuple[int, ...]] = []
            for (v, g, h, copies, text), ranges in zip(held, RunIndex([x[4] for x in held]).repeated(length), strict=True):
                whole = [(0, len(text) - length + 1)]
                out += [(v, g, h, a, b) for a, b in (whole if copies > 1 else ranges)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["v", "g", "h", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= shard_bytes and row[0] != held[-1][0]:
                    yield decide()
                    size = 0
                held.append(row)
                size += len(row[4])
        if held:
            yield decide()

    return content.repartition(F.col("v")).sortWithinPartitions("v").mapInArrow(run, "v bigint, g bigint, h bigint, a bigint, b bigint")


def _repeats(rows: DataFrame, length: int, grams: list[int], shard_bytes: int, crowded_bytes: int, left: list[DataFrame]) -> DataFrame:
    """key, [a, b): bytes of each of ``rows`` (key, copies, text) that belong to a string which also is elsewhere.

    What is shared is written and joined back from there: both sides of such a join are plain exchanges, whose large
    partitions Spark splits while it copies the one row of the other side. The tables that the result reads go to ``left``.
    """
    kind = rows.schema["key"].dataType.simpleString()
    all_pieces = _occurrences(rows, kind, length, grams[0])
    ends = [f(c).alias(f"{c}{i}") for c in "gh" for i, f in enumerate((F.min, F.max))]
    shared = all_pieces.groupBy("v").agg(F.sum("copies").alias("c"), *ends).where("c > 1")
    shared = materialize(shared.select("v", F.expr("g0 != g1 or h0 != h1").alias("many")), "suffix-shared")
    found = materialize(all_pieces.join(shared, "v").select("key", "start", "n", "v", "g", "h", "many"), "suffix-found")
    drop_table(shared)
    todo = found.where("many").groupBy("key").agg(F.collect_list(F.struct("start", "n", "v", "g", "h")).alias("open"))
    content = _content_rows(rows.join(todo, "key"), length)
    content = content.groupBy("v", "g", "h").agg(F.sum("copies").alias("copies"), F.first("content").alias("content"))
    content = materialize(content.select("v", "g", "h", "copies", "content"), "suffix-content")
    crowded = materialize(content.groupBy("v").agg(F.sum(F.octet_length("content")).alias("size")).where(F.col("size") > crowded_bytes).select("v"), "suffix-crowded")
    ranges = _indexed(content.join(crowded, "v", "left_anti"), length, shard_bytes)
    used = [content, crowded]
    if len(grams) > 1 and crowded.head(1):
        inner = content.join(crowded, "v").select(F.struct("v", "g", "h").alias("key"), "copies", F.col("content").alias("text"))
        used.append(materialize(inner, "suffix-divided"))
        deeper = _repeats(used[-1], length, grams[1:], shard_bytes, crowded_bytes, used)
        ranges = ranges.union(deeper.select("key.v", "key.g", "key.h", "a", (F.col("b") - (length - 1)).alias("b")))
    ranges = materialize(ranges, "suffix-ranges")
    for table in used:
        drop_table(table)
    left += [found, ranges]
    end = length - 1
    whole = found.where("not many").select("key", F.col("start").alias("a"), (F.col("start") + F.col("n") + end).alias("b"))
    part = found.where("many").join(ranges, ["v", "g", "h"]).select("key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + end).alias("b"))
    return whole.union(part)


def repeated_strings(docs: DataFrame, key: str, text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, crowded_bytes: int = CROWDED_BYTES) -> DataFrame:
    """``key``, ``spans``: for each text with repeats an array of ranges [a, b) of bytes to remove (may overlap)."""
    ready(docs)
    rows = docs.select(F.col(key).alias("key"), F.lit(1).cast("long").alias("copies"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _repeats(rows, length, gram_sizes(length), shard_bytes, crowded_bytes, []).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = True, **options) -> tuple[DataFrame, str]:
    """All columns and a struct column, whose name is returned too: n_bytes, n_removed, spans, kept_sha256, kept (bytes)."""
    ready(docs)
    rows, key = keyed(docs, id_col)
    spans = repeated_strings(rows, key, text_col, length, **options)
    x, made = free_name(rows.columns, "spans"), free_name(docs.columns, "suffix_dedup")
    found = rows.join(spans.select(F.col("key").alias(x + "_key"), F.col("spans").alias(x)), F.col(key) == F.col(x + "_key"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], x)
    kind = "struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<a:bigint,b:bigint>>,kept_sha256:string" + ",kept:binary>" * with_bytes + ">" * (not with_bytes)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, raw in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data, cuts = (text or "").encode(), merged(raw)
                parts, last = [], 0
                for a, b in cuts:
                    parts.append(data[last:a])
                    last = b
                kept = b"".join([*parts, data[last:]])
                row = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "spans": [{"a": a, "b": b} for a, b in cuts], "kept_sha256": hashlib.sha256(kept).hexdigest()}
                rows.append(row | {"kept": kept} if with_bytes else row)
            fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_bytes
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.struct(fields))], names=[*batch.schema.names[:-1], made])

    return found.mapInArrow(run, with_field(docs.schema, made, kind)), made
