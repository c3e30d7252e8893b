"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, scored by sharded count joins.

Trained on the trusted documents: each task counts the n-grams of its rows, the counts are summed by n-gram, and
the lower orders, discounts and back-off weights are tables sharded by n-gram, which grow with the trusted text. To
score, the documents are taken in blocks of rows; each block asks once for each n-gram that it has, however often it
occurs there, and all orders' counts are joined to the n-grams asked for. The answers meet their block's documents by a
shuffle in which a task holds the n-grams of one block at a time. No table of the model reaches the driver or is broadcast.

A document's perplexity is rejected outside two quantiles of its language. The upper one is taken from a fifth of the
trusted documents, which the model has not seen; the lower one from all of them, since what the model has seen is more
predictable and must not be rejected for that. Characters are code points; those from 3072 on share 1024 symbols of their own,
so scripts below keep apart from each other and from the others. White space counts as one character each.

Nulls: a null text is empty; texts without a word are rejected and have perplexity null. A null language, or one without
held-out trusted documents, takes the quantiles of all together; without any nothing but empty texts is rejected.
Repeated rows are judged one by one; a repeated or null id in the trust table counts once or not at all. Very long texts
are scored whole, slice by slice. Empty tables give empty results. Columns of the documents pass through unchanged; the
added one takes a name that none of them has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_table, materialize, ready, text_slices
from .keys import free_name, keyed

ORDER = 5
SYMBOL_BITS = 12
SYMBOLS, SHARED = 1 << SYMBOL_BITS, 3072
#: Characters of average text by which short documents are drawn to their language's mean.
PRIOR_CHARS = 64
#: Quantiles of held-out trusted documents between which a document is kept; one of so many trusted ones is held out.
LOW, HIGH, HELD_OUT = 0.002, 0.998, 5
#: Rows of a file that ask for their n-grams together.
BLOCK_ROWS = 8192
ALL = ""

_MIX = np.uint64(0x9E3779B97F4A7C15)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = np.where(points < SHARED, points, SHARED + points % (SYMBOLS - SHARED)).astype(np.uint64)
    out[(points >= 9) & (points <= 13)] = 32
    return out


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each begun by white space, where each text's codes begin, and the texts' lengths."""
    pad = " " * (order - 1)
    points = symbols(pad + pad.join(texts))
    n = max(len(points) - order + 1, 0)
    codes = np.zeros(n, np.uint64)
    for i in range(order):
        codes <<= np.uint64(SYMBOL_BITS)
        codes |= points[i : i + n]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + order - 1) - lengths - (order - 1)
    return codes, begins, lengths


def own_codes(texts: list[str]) -> np.ndarray:
    """Codes of the texts without those that span two texts."""
    codes, begins, lengths = grams(texts)
    edge = np.zeros(len(codes) + 1, np.int32)
    np.add.at(edge, begins[lengths > 0], 1)
    np.add.at(edge, (begins + lengths)[lengths > 0], -1)
    return codes[np.cumsum(edge[:-1]) > 0]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    for row, offsets, _ in text_slices(batch, column, 2 << 20):
        yield row, [x or "" for x in batch.column(batch.schema.get_field_index(column)).slice(row, len(offsets) - 1).to_pylist()]


def count_grams(texts: DataFrame) -> DataFrame:
    """``g``, ``c`` over a frame with the one column ``text``; each task sums what it has read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)].view(np.int64)), pa.array(sums[a : a + (1 << 16)])], names=["g", "c"])

        for batch in batches:
            for _, part in _slices(batch, "text"):
                found, n = np.unique(own_codes(part), return_counts=True)
                both, at = np.unique(np.concatenate((keys, found)), return_inverse=True)
                keys, sums = both, np.bincount(at, np.concatenate((sums, n)), len(both)).astype(np.int64)
                if len(keys) > 1 << 21:  # memory stays bounded; what is split here is summed after the shuffle
                    yield from out()
                    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from out()

    return texts.mapInArrow(run, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def _suffix(g: str, order: int) -> Column:
    return F.col(g).bitwiseAND(F.lit((1 << SYMBOL_BITS * order) - 1))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4."""
    got = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    return discounts(*(got.get(i, 0) for i in range(1, 5)))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Kept inside (0, count), also where a small corpus lacks some counts."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))


class Model:
    """For each order the discounted shares ``g``, ``a`` and the weights ``h``, ``gamma`` of contexts, as tables.

    The highest order has the counts, the lower ones the numbers of distinct left neighbours.
    """

    def __init__(self, texts: DataFrame) -> None:
        ready(texts)
        self.shares: dict[int, DataFrame] = {}
        self.weights: dict[int, DataFrame] = {}
        counts = materialize(count_grams(texts.select(F.coalesce("text", F.lit("")).alias("text"))), "lm-counts")
        self.tables = [counts]
        for k in range(ORDER, 0, -1):
            d1, d2, d3 = _discounts(counts)
            cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
            table = counts.select("g", F.shiftright("g", SYMBOL_BITS).alias("h"), "c", cut.alias("d"))
            contexts = materialize(table.groupBy("h").agg(F.sum("c").alias("total"), F.sum("d").alias("cut")), f"lm-contexts-{k}")
            self.weights[k] = contexts.select("h", (F.col("cut") / F.col("total")).alias("gamma"))
            self.shares[k] = table.join(contexts, "h").select("g", ((F.col("c") - F.col("d")) / F.col("total")).alias("a"))
            self.tables.append(contexts)
            if k > 1:
                self.tables.append(counts := materialize(counts.groupBy(_suffix("g", k - 1).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"lm-counts-{k - 1}"))

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """``g``, ``p`` for the distinct n-grams ``asked`` (column ``g``), order by order; each join is on n-grams or contexts."""
        wanted = {ORDER: asked}
        for k in range(ORDER - 1, 0, -1):
            wanted[k] = materialize(wanted[k + 1].select(_suffix("g", k).alias("g")).distinct(), f"lm-asked-{k}")
        p = None
        for k in range(1, ORDER + 1):
            rows = wanted[k].select("g", F.shiftright("g", SYMBOL_BITS).alias("h"), _suffix("g", k - 1).alias("s"))
            lower = F.lit(1.0 / SYMBOLS) if p is None else F.col("lower")
            rows = rows if p is None else rows.join(p.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
            rows = rows.join(self.shares[k], "g", "left").join(self.weights[k], "h", "left")
            value = F.coalesce("a", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * lower
            before, p = p, materialize(rows.select("g", value.alias("p")), f"lm-p-{k}")
            if before is not None:
                drop_table(before)
            if k < ORDER:
                drop_table(wanted[k])
        return p


class _Seen:
    """Drops most n-grams that were seen before in a block; what slips through again does no harm."""

    def __init__(self) -> None:
        self.table = np.full(1 << 20, ~np.uint64(0), np.uint64)

    def new(self, codes: np.ndarray) -> np.ndarray:
        codes = np.unique(codes[self.table[codes * _MIX >> np.uint64(44)] != codes])
        self.table[codes * _MIX >> np.uint64(44)] = codes
        return codes


class Lookup:
    """Values of known codes: a table of slots, and a search where two codes share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, len(keys).bit_length() + 1))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self.keys * _MIX >> self.shift] = np.arange(len(keys), dtype=np.int32)

    def get(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        at = self.slots[codes * _MIX >> self.shift]
        rest = np.flatnonzero(self.keys[at] != codes)
        at[rest] = np.minimum(np.searchsorted(self.keys, codes[rest]), len(self.keys) - 1)
        if (self.keys[at[rest]] != codes[rest]).any():
            raise RuntimeError("an n-gram that its block has not asked for")
        return self.values[at]


def _ask(rows: DataFrame) -> DataFrame:
    """``block``, ``g``: what each block asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, _Seen()
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, seen = blocks[a], _Seen()
                for _, part in _slices(batch.slice(a, b - a), "text"):
                    new = seen.new(own_codes(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), block)), pa.array(new.view(np.int64))], names=["block", "g"])

    return rows.select("block", "text").mapInArrow(run, "block bigint, g bigint").distinct()


def score(docs: DataFrame, model: Model, key: str, text_col: str = "text") -> DataFrame:
    """``key``, ``nats`` (the sum of -log p) and ``chars`` (0: no word) of each row, written; the model's tables are deleted.

    A block is named by the file and the number of its rows in it, so it stays the same wherever a row is read; frames
    that are not read from files are written first.
    """
    kind = docs.schema[key].dataType.simpleString()
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("block")
    own = [F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    try:
        rows = docs.select(place, *own)
    except AnalysisException:
        rows = materialize(docs.select(*own), "lm-docs").select(place, "key", "text")
    asked = materialize(_ask(rows), "lm-asked")
    p = model.probabilities(materialize(asked.select("g").distinct(), "lm-asked-all"))
    told = materialize(asked.join(p, "g").select("block", "g", (-F.log("p")).cast("float").alias("cost")), "lm-told")
    for table in (asked, p, *model.tables):
        drop_table(table)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = told.select("block", F.lit(0).alias("kind"), "g", "cost", none("key", kind), none("text", "string"))
    both = both.union(rows.select("block", F.lit(1).alias("kind"), none("g", "bigint"), none("cost", "float"), "key", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, known = None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, held, known = blocks[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append((part.column(2).to_numpy().view(np.uint64), part.column(3).to_numpy()))
                    continue
                if known is None:
                    known = Lookup(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else Lookup(np.zeros(0, np.uint64), np.zeros(0, np.float32))
                    held = []
                for row, texts in _slices(part, "text"):
                    codes, begins, lengths = grams(texts)
                    inside = np.zeros(len(codes) + 1, np.int32)
                    np.add.at(inside, begins[lengths > 0], 1)
                    np.add.at(inside, (begins + lengths)[lengths > 0], -1)
                    mine = np.flatnonzero(np.cumsum(inside[:-1]))
                    cost = np.zeros(len(codes) + 1)
                    cost[mine + 1] = known.get(codes[mine])
                    sums = np.cumsum(cost)
                    words = np.fromiter((bool(t.strip("\t\n\x0b\x0c\r ")) for t in texts), bool, len(texts))
                    nats = np.where(words, sums[begins + lengths] - sums[begins], 0.0)
                    yield pa.RecordBatch.from_arrays([part.column(4).slice(row, len(texts)), pa.array(nats), pa.array(lengths * words)], names=["key", "nats", "chars"])

    dealt = both.repartition("block").sortWithinPartitions("block", "kind")
    found = materialize(dealt.mapInArrow(run, f"key {kind}, nats double, chars bigint"), "lm-scores")
    drop_table(told)
    return found


def _smoothed(mean: Column) -> Column:
    return (F.col("nats") + PRIOR_CHARS * mean) / (F.col("chars") + PRIOR_CHARS)


def limits_of(scored: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``lang``, ``mean``, ``low``, ``high`` for each language of the scored trusted rows and for all together (``''``).

    The mean and the upper limit come from the rows ``held_out``; a language without any is left out.
    """
    rows = scored.where("chars > 0").select(F.coalesce("lang", F.lit(ALL)).alias("lang"), "nats", "chars", "held_out")
    rows = rows.union(rows.where(F.col("lang") != ALL).select(F.lit(ALL).alias("lang"), "nats", "chars", "held_out"))
    means = rows.where("held_out").groupBy("lang").agg((F.sum("nats") / F.sum("chars")).alias("mean"))
    one = rows.join(broadcast_if_small(means), "lang").select("lang", "mean", "held_out", _smoothed(F.col("mean")).alias("x"))
    upper = F.percentile_approx(F.when(F.col("held_out"), F.col("x")), high, 10000)
    table = one.groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx("x", low, 10000).alias("low"), upper.alias("high"))
    return materialize(table, "lm-limits")


def verdicts(docs: DataFrame, trusted: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``key`` (a column of ``docs`` without nulls or repeats), perplexity, low, high, kept.

    ``trusted`` has the trusted ids in its first column.
    """
    ready(docs)
    ids = trusted.select(F.col(trusted.columns[0]).alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = materialize(ids.select("trusted_id", (F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT)) == 0).alias("held_out")), "lm-ids")
    learnt = broadcast_if_small(ids.where("not held_out").select("trusted_id"))
    good = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = Model(good.join(learnt, F.col("id") == F.col("trusted_id"), "left_semi").select("text"))
    scores = score(docs, model, key, text_col)
    about = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    scored = materialize(scores.join(about, "key"), "lm-scored")
    drop_table(scores)
    limits = limits_of(scored.join(broadcast_if_small(ids), F.col("id") == F.col("trusted_id")), low, high)
    whole = limits.where(F.col("lang") == ALL).head()
    rest = F.struct(*[F.lit(whole[c] if whole else None).cast("double").alias(c) for c in ("mean", "low", "high")])
    own = limits.where(F.col("lang") != ALL).select("lang", F.struct("mean", "low", "high").alias("own"))
    limit = F.coalesce("own", rest)
    value = F.when(F.col("chars") > 0, _smoothed(F.coalesce(limit["mean"], F.lit(0.0))))
    kept = F.coalesce(value.between(limit["low"], limit["high"]), F.col("chars") > 0)
    made = [F.exp(value).alias("perplexity"), F.exp(limit["low"]).alias("low"), F.exp(limit["high"]).alias("high"), kept.alias("kept")]
    return scored.join(broadcast_if_small(own), "lang", "left").select(F.col("key").alias(key), *made)


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a struct column (its name is returned too): perplexity, low, high, kept."""
    ready(docs)
    rows, key = keyed(docs, id_col)
    made, other = free_name(docs.columns, "lm"), free_name(rows.columns, "lm_key")
    found = verdicts(rows, trusted, key, id_col, text_col, lang_col, **options)
    found = found.select(F.col(key).alias(other), F.struct("perplexity", "low", "high", "kept").alias(made))
    return rows.join(found, F.col(f"`{key}`") == F.col(other)).select(*[F.col(f"`{c}`") for c in docs.columns], made), made
