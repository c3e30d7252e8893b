"""Best-fit-decreasing packing of tokenised documents.

Best fit looks only at lengths, so the packing of all documents is computed from one count for each length: the
equal pieces of a length are placed together, bins with equal room form one class, and a segment tree over
the capacities finds the tightest open class in logarithmic time. The result is a short table of placements
(at most a few for each length); documents find theirs by their rank within their length.

Nulls: a null text counts as empty, that is one end token; a null id is carried along. Repeated rows and ids are
packed one by one. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blank, broadcast_if_small, materialize, ready

#: Runs of this much white space take the splitter that needs no stack.
SPACES = 2000


class CapacityTree:
    """Segment tree over capacities 0..size that finds the least capacity, from a bound on, that has open bins."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass(frozen=True)
class Placement:
    """The pieces of ``length`` with ranks from ``rank``: ``each`` to a sequence, in ``bins`` sequences from ``first``."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Placement]:
    """Exactly what best fit does to the pieces one by one, longest first, but for whole classes at a time.

    After a bin has taken a piece it is the tightest bin for the next equal piece if that still fits, so each bin of
    a class takes as many as fit before the next one is touched.
    """
    tree = CapacityTree(capacity)
    classes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity -> [(first sequence, sequences)]
    out: list[Placement] = []
    sequences = 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            classes[room].append((first, bins))
            tree.add(room, 1)

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            each = (capacity if room is None else room) // length
            if room is None:
                first, bins = sequences, -(-left // each)
                sequences += bins
                room = capacity
            else:
                first, bins = classes[room].pop()
                tree.add(room, -1)
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            if full:
                out.append(Placement(length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins:
                if rest:
                    out.append(Placement(length, rank, rest, first + full, rest, capacity - room))
                    put(room - rest * length, first + full, 1)
                    rank, left = rank + rest, 0
                put(room, first + full + (rest > 0), bins - full - (rest > 0))
    return out


def _pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length): pieces of ``most`` tokens; if the first is shorter it comes first."""
    head = n % most
    cuts = ([0] if head else []) + list(range(head, n, most))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:] + [n], strict=True)]


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def _vocabulary(path: str) -> tuple[dict, dict[bytes, int]]:
    """The file's contents, and the ids by the bytes of their tokens."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return whole, {bytes(byte_of[c] for c in s): i for s, i in whole["model"]["vocab"].items() if all(c in byte_of for c in s)}


@functools.lru_cache(maxsize=8)
def merges_by_id(path: str) -> bool:
    """Whether merging any neighbours that make a token, by the token's id, gives the file's own ids.

    So it is if the merges' results have ascending ids and each token is what its own text is merged to, since inside a
    token's span no other way leads to it then; and if the file splits texts by ``PRE_TOKEN``, without normalising them.
    """
    whole, ranks = _vocabulary(path)
    model = whole["model"]
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if model.get("type", "BPE") != "BPE" or any(x >= y for x, y in zip(made, made[1:])) or len({*range(256)} & {t[0] for t in ranks if len(t) == 1}) < 256:
        return False
    before = whole.get("pre_tokenizer") or {}
    own = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not own or whole.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    special = {t["content"] for t in whole.get("added_tokens", [])}
    merge = _tokenizer(path).model.tokenize
    return all(token in special or [t.id for t in merge(token)] == [number] for token, number in model["vocab"].items())


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, the same that ``tokenizers`` gives for the file.

    With ``fast``, which ``merges_by_id`` must have allowed for the file, ``tiktoken`` makes them. Long runs of white
    space overflow the stack of its splitter, so texts with one are split here and merged by ``tokenizers``, as all texts
    are for other files.
    """

    def __init__(self, path: str, fast: bool) -> None:
        import regex
        import tiktoken

        self.path, self.fast, self.slow = path, None, None
        if fast:
            _, ranks = _vocabulary(path)
            self.fast = tiktoken.Encoding("byte-level", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.long_run = re.compile(r"\s{%d}" % SPACES).search
        self.split = regex.compile(PRE_TOKEN).findall

    def __call__(self, text: str) -> bytes:
        if self.fast and not self.long_run(text):
            return np.array(self.fast(text), "<u4").tobytes()
        if self.slow is None:
            self.slow = _tokenizer(self.path)
        if not self.fast:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.split(text)
        new = list(dict.fromkeys(parts))
        known = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(new, self.slow.encode_batch(new, add_special_tokens=False), strict=True)}
        return b"".join([known[p] for p in parts])


#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their block (a written file of one task) and rank among the block's pieces of equal length."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", "block", "nth"]
    fast = merges_by_id(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(path, fast)
        end = np.array([end_id], "<u4").tobytes()
        block = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            which: list[int] = []
            rows: list[tuple[int, ...]] = []
            for row in range(batch.num_rows):
                ids = encode(batch.column(1)[row].as_py()) + end
                for piece, (start, length) in enumerate(_pieces(len(ids) // 4, capacity)):
                    which.append(row)
                    rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), block, seen[length]))
                    seen[length] += 1
            got = np.array(rows, np.int64).reshape(-1, 6).T
            cols = [pa.array(c) for c in got]
            cols[0] = cols[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *cols], names=names)

    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, nth bigint"
    return docs.select(F.col(id_col).alias(id_col), blank(F.col(text_col)).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver holds one count for each length and the placements, both bounded by the capacity. A piece's rank
    within its length is its rank in its block plus the counts of earlier blocks, so no length is gathered in
    one task; the pieces are a written table, so a task that runs again cannot change the ranks.
    """
    spark = ready(docs)
    pieces = materialize(tokenized_pieces(docs, path or tokenizer_path(), capacity, end_id, id_col, text_col), "pieces")
    blocks = materialize(pieces.groupBy("block", "length").agg((F.max("nth") + 1).alias("n")), "blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    base = blocks.select("block", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    placed = [(p.length, p.rank, p.count, p.first, p.each, p.offset) for p in best_fit_decreasing(counts, capacity)]
    plan = spark.createDataFrame(placed, "length long, rank long, count long, first long, each long, offset0 long")
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank", "count", "first", "each", "offset0"))).alias("plan"))
    rank = F.col("nth") + F.col("before")
    ranked = pieces.join(base, ["block", "length"]).select("*", rank.alias("rank")).join(broadcast_if_small(plan), "length")
    own = F.element_at(F.filter("plan", lambda p: (p["rank"] <= F.col("rank")) & (F.col("rank") < p["rank"] + p["count"])), 1)
    found = ranked.select(id_col, "piece", "start", "length", "ids_crc32", "rank", own.alias("p"))
    nth = F.col("rank") - F.col("p.rank")
    return found.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("p.first") + F.floor(nth / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.offset0") + (nth % F.col("p.each")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences_of(lengths: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length of a small list, for tests and callers without Spark."""
    lengths = list(lengths)
    counts: dict[int, int] = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    plan = defaultdict(list)
    for p in best_fit_decreasing(counts, capacity):
        plan[p.length].append(p)
    seen: dict[int, int] = defaultdict(int)
    out = []
    for n in lengths:
        rank = seen[n]
        seen[n] += 1
        p = next(p for p in plan[n] if p.rank <= rank < p.rank + p.count)
        k = rank - p.rank
        out.append((p.first + k // p.each, p.offset + k % p.each * n))
    return out
