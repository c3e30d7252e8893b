"""Removal of word sequences that an earlier document has, by difference-cover anchors.

The positions 0, 1, 2, ... of a text are taken modulo a period; at those in a difference cover, the next ``ANCHOR`` words
are hashed. For any two offsets there is a shift below the period that moves both onto the cover, so two equal
windows always have an equal anchor at the same place inside them. Anchors are counted by hash with the least
document; only shared ones are extended. If all occurrences of an anchor have the same surroundings, all its windows are
decided at once; otherwise its windows are compared.

Words have two hashes that are mixed byte by byte on their own (eight bytes a step, each step a bijection of those
bytes, so words of up to eight bytes and equal length never collide). Anchors are made of the first ones, surroundings
of the second, and windows are compared by a hash of each: every decision rests on 128 independent bits.

Nulls: a null text has no words; a null id is neither before nor after any other. Repeated ids are equal, so
their rows do not remove from each other. Texts shorter than a window lose nothing. Empty tables give empty results.
All columns pass through; the added one takes a name that none of them has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, ready, splitmix, text_slices
from .keys import free_name, keyed, with_field

WINDOW = 50
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Words of a text around an anchor at 0 that its windows can have: [-BEFORE, AFTER).
BEFORE, AFTER = PERIOD - 1, WINDOW

#: Odd, and 5 modulo 8, so that powers repeat as late as they can modulo 2**64.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D, 0xD6E8FEB86659FD95)]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse."""

    def __init__(self, base: np.uint64) -> None:
        self.bases = np.array([int(base) | 1, pow(int(base) | 1, -1, 1 << 64)], np.uint64)
        self.size, self.up, self.down = 0, None, None

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            full = np.repeat(self.bases[:, None], self.size, axis=1)
            full[:, 0] = 1
            self.up, self.down = np.cumprod(full, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(x) for x in _MIX[1:]]


class Prefixes:
    """Hashes of any range of a sequence of 64-bit values, from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, which: int) -> None:
        up, self.down = _POWERS[which].get(len(values) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.down[a]
        return splitmix(h ^ ((b - a).astype(np.uint64) * _MIX[1]))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each range of bytes. Very long words only cost steps of their own."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = (ends - begins).astype(np.uint64)
    one, two = size * _MIX[0], splitmix(size ^ _MIX[2])
    live, at = np.arange(len(begins)), begins
    while len(live):
        room = np.minimum(ends[live] - at, 8)
        part = eight[at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * room.astype(np.uint64)))
        one[live] = splitmix((one[live] ^ part) * _MIX[0])
        mixed = (two[live] + part) * _MIX[2]
        two[live] = splitmix((mixed ^ (mixed >> np.uint64(32))) * _MIX[1])
        more = np.flatnonzero(ends[live] - at > 8)
        live, at = live[more], at[more] + 8
    return one, two


class Words:
    """The words of a slice of texts: where they are, their two hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        word = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        self.begins = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.begins, offsets)
        self.counts = np.diff(self.first)
        self.hashes, self.others = word_hashes(data, self.begins, self.ends)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position in the text, anchor hash, hash of the surroundings) at the cover positions."""
    n = len(words.hashes)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    at = np.arange(n) - words.first[text]
    size = words.counts[text]
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    chosen = np.flatnonzero(on[at % PERIOD] & (size >= WINDOW) & (at + ANCHOR <= size)) if n else np.zeros(0, np.int64)
    text, at, size = text[chosen], at[chosen], size[chosen]
    anchor = Prefixes(words.hashes, 0).ranges(chosen, chosen + ANCHOR)
    left, right = np.minimum(at, BEFORE), np.minimum(size - at, AFTER)
    around = Prefixes(words.others, 1).ranges(chosen - left, chosen + right)
    around = splitmix(around ^ (left * 128 + right).astype(np.uint64) * _MIX[2])
    return text, at, anchor, around


def _anchor_rows(rows: DataFrame, kinds: str, extra: int) -> DataFrame:
    names = [c.split(" ")[0] for c in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_slices(batch, "text", 1 << 20):
                text, at, anchor, around = anchors(Words(data, offsets))
                own = [batch.column(i).take(pa.array(text + row)) for i in range(extra)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64))], names=[*names, "at", "anchor", "around"])

    return rows.mapInArrow(run, f"{kinds}, at int, anchor bigint, around bigint")


def _window_rows(found: DataFrame, kinds: str, extra: int) -> DataFrame:
    """The windows around the anchors listed in ``open``: start and two hashes."""
    names = [c.split(" ")[0] for c in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = batch.column(extra + 1)
            for row, offsets, data in text_slices(batch, "text", 1 << 20):
                words = Words(data, offsets)
                one, two = Prefixes(words.hashes, 0), Prefixes(words.others, 1)
                starts, texts = [], []
                for t in range(len(offsets) - 1):
                    last = words.counts[t] - WINDOW
                    edge = np.zeros(last + 2, np.int32)
                    at = np.array(todo[row + t].as_py(), np.int64)
                    np.add.at(edge, np.maximum(at - BEFORE, 0), 1)
                    np.add.at(edge, np.minimum(at, last) + 1, -1)
                    own = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    starts.append(own + words.first[t])
                    texts.append(np.full(len(own), t))
                start, text = np.concatenate(starts), np.concatenate(texts)
                cols = [batch.column(i).take(pa.array(text + row)) for i in range(extra)]
                cols.append(pa.array((start - words.first[text]).astype(np.int32)))
                cols += [pa.array(p.ranges(start, start + WINDOW).view(np.int64)) for p in (one, two)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "at", "x", "y"])

    return found.mapInArrow(run, f"{kinds}, at int, x bigint, y bigint")


def repeated_words(docs: DataFrame, key: str, order: str, text_col: str = "text") -> DataFrame:
    """``key``, ``spans``: ranges [a, b) of words to remove (may overlap) for each text that has any.

    Anchors and windows are aggregated to their least document before and after the shuffle, so one that very many
    documents share is never gathered. What is found is written and joined back from there: both sides of such a join
    are plain exchanges, whose large partitions Spark splits while it copies the one row of the other side.
    """
    ready(docs)
    kind, order_kind = (docs.schema[c].dataType.simpleString() for c in (key, order))
    same = key == order
    o = "key" if same else "ord"
    own = [F.col(key).alias("key")] + ([] if same else [F.col(order).alias("ord")])
    kinds = f"key {kind}" + ("" if same else f", ord {order_kind}")
    rows = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    extra = len(own)
    names = [c.split(" ")[0] for c in kinds.split(", ")]
    found = _anchor_rows(rows, kinds, extra)
    group = found.groupBy("anchor").agg(F.min(o).alias("least"), F.max(o).alias("most"), F.min("around").alias("s0"), F.max("around").alias("s1"))
    shared = materialize(group.where("least < most").select("anchor", "least", (F.col("s0") != F.col("s1")).alias("many")), "anchors-shared")
    hits = found.drop("around").join(shared, "anchor").where(F.col("many") | (F.col(o) > F.col("least")))
    hits = materialize(hits.select(*names, "at", "many"), "anchors-found")
    drop_table(shared)
    todo = hits.where("many").groupBy("key").agg(F.collect_list("at").alias("open"))
    texts = rows.join(todo, "key").select(*names, "text", "open")
    windows = materialize(_window_rows(texts, kinds, extra), "anchors-windows")
    first = windows.groupBy("x", "y").agg(F.min(o).alias("least"), F.max(o).alias("most")).where("least < most").select("x", "y", "least")
    first = materialize(first, "windows-first")
    later = windows.join(first, ["x", "y"]).where(F.col(o) > F.col("least"))
    spans = later.select("key", F.col("at").cast("long").alias("a"), (F.col("at") + WINDOW).cast("long").alias("b"))
    whole = hits.where("not many").select("key", F.greatest(F.col("at") - BEFORE, F.lit(0)).cast("long").alias("a"), (F.col("at") + AFTER).cast("long").alias("b"))
    return spans.union(whole).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", joined: bool = False) -> tuple[DataFrame, str]:
    """All columns and a struct column, whose name is returned too: n_words, n_removed, spans, kept_text.

    ``spans`` are ranges [a, b) of removed words. ``kept_text`` is the text without the removed words and the white
    space after each, or with ``joined`` the kept words joined by one space.
    """
    ready(docs)
    rows, key = keyed(docs, id_col)
    spans = repeated_words(rows, key, id_col, text_col)
    x, made = free_name(rows.columns, "spans"), free_name(docs.columns, "substring_dedup")
    found = rows.join(spans.select(F.col("key").alias(x + "_key"), F.col("spans").alias(x)), F.col(key) == F.col(x + "_key"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], x)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .suffix_dedup import merged

        for batch in batches:
            out = []
            for text, raw in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = (text or "").encode()
                if not raw:
                    words = data.split()
                    out.append((len(words), 0, [], b" ".join(words).decode() if joined else text or ""))
                    continue
                own = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                n = len(own.begins)
                cuts = [(a, min(b, n)) for a, b in merged(raw)]
                removed = sum(b - a for a, b in cuts)
                keep = [(i, j) for i, j in zip([0] + [b for _, b in cuts], [a for a, _ in cuts] + [n], strict=True) if i < j]
                if joined:
                    kept = b" ".join(b" ".join(data[own.begins[i] : own.ends[j - 1]].split()) for i, j in keep)
                else:
                    head = data[: own.begins[0]] if n and keep and keep[0][0] == 0 else b""
                    kept = head + b"".join(data[own.begins[i] : own.begins[j] if j < n else len(data)] for i, j in keep)
                out.append((n, removed, [{"a": a, "b": b} for a, b in cuts], kept.decode()))
            fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept_text", pa.string())]
            rows = pa.array([dict(zip((f[0] for f in fields), r, strict=True)) for r in out], pa.struct(fields))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], names=[*batch.schema.names[:-1], made])

    kind = "struct<n_words:bigint,n_removed:bigint,spans:array<struct<a:bigint,b:bigint>>,kept_text:string>"
    return found.mapInArrow(run, with_field(docs.schema, made, kind)), made
