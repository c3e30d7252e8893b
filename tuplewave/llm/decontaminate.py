"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are lower-cased and their words joined by one space. A window begins at a word and has as many characters as the
item. The CGK random walk copies the characters of the whole window, and of the item, to an output twice as long, moving on
at each step or not by a random function of the step and the character; strings at a small edit distance resynchronise, so
their outputs are at a small Hamming distance. Each repetition has a walk of its own and samples positions over its whole
length; a window and an item are a candidate pair if all samples of one repetition agree, as those of exact copies always
do. The number of repetitions is found by experiment: items are edited as much as ``EDITS`` allows, and repetitions are
doubled until a share of ``RECALL`` of them is found. Candidates are verified by exact edit distance, free at the
window's end.

Pairs that cannot match are left out before the walk by a bound that loses nothing: k edits spoil at most k*q
of an item's q-grams, so a window with fewer q-grams of the item than that leaves is farther than k away. The q-grams are
counted for groups of items of similar length first, then for each item of the groups that pass, where a q-gram
counts only if it is at most k characters from its place in the item. An item too short for the bound is cut into k + 1
pieces, one of which k edits leave whole, and looked for by its pieces.

Nulls: null texts and items are empty and match nothing, null ids are carried along. Repeated rows are searched one by
one, repeated items found once each. Empty tables give empty results. Only ids and texts are read. Ties:
of overlapping candidates for one item the closest, then first, is reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, ready, splitmix

Q = 8
#: Share of an item's characters that may be edited.
EDITS = 0.1
#: Sampled positions of a walk; repetitions of the first round; the most that the experiment may ask for.
SAMPLED, FIRST, MOST = 4, 8, 512
#: Share of passages at the limit of edits that the repetitions must find in the experiment.
RECALL = 0.98
#: Items and characters of items searched at once; more are searched in blocks.
BLOCK_ITEMS, BLOCK_CHARS = 5000, 4 << 20
#: Pairs that are walked together.
PAIRS = 256
_TABLE_BITS = 22
#: q-grams with more places in the items are not counted; an item's bound is lowered by as many as it has of them.
COMMON = 32
#: Groups of items that the table of q-grams tells apart.
BITS = 64


def normal(text: str | None) -> list[str]:
    return (text or "").lower().split()


def edit_distance_prefix(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end): the prefix of ``text`` closest to ``pattern``, if within ``most``; bit-parallel, by Myers."""
    m = len(pattern)
    if not m:
        return (0, 0)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text[: m + most], 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        best = min(best, (score, j))
    return best if best[0] <= most else None


def _gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of each run of eight code points, by doubling."""
    h = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + (h[step:] ^ (h[step:] >> np.uint64(29)))
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _TABLE_BITS)


def embed(texts: list[str], sizes: np.ndarray, repetitions: range) -> np.ndarray:
    """[text, repetition, sample]: the walked characters at the sampled positions. A text is read up to its size, then zeros."""
    n, r = len(texts), len(repetitions)
    width = int(sizes.max(initial=0)) + 1
    flat = np.zeros((n, width), np.uint32)
    for row, text, size in zip(flat, texts, sizes.tolist(), strict=True):
        points = np.frombuffer(text[:size].encode("utf-32-le"), "<u4")
        row[: len(points)] = points
    flat = flat.reshape(-1)
    seeds = np.arange(repetitions.start, repetitions.stop, dtype=np.uint64)[:, None]
    share = splitmix(seeds * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, SAMPLED + 1, dtype=np.uint64)) >> np.uint64(11)
    place = (share.astype(np.float64) * 2.0**-53 * (2 * sizes)[:, None, None]).astype(np.int64).reshape(-1)
    order = np.argsort(place, kind="stable")
    last = int(place.max(initial=-1))
    cuts = np.searchsorted(place[order], np.arange(last + 2)).tolist()
    cell = order // SAMPLED
    random = splitmix((seeds.T << np.uint64(32)) + np.arange(1, last + 2, dtype=np.uint64)[:, None])
    factor, shift = (random | np.uint64(1)).astype(np.uint32), (random >> np.uint64(32)).astype(np.uint32)
    base = np.repeat(np.arange(n) * width, r)
    end = base + np.repeat(sizes, r)
    at, out = base.copy(), np.zeros(len(place), np.uint32)
    for j in range(last + 1):
        letter = flat[at]
        a, b = cuts[j], cuts[j + 1]
        if a < b:
            out[order[a:b]] = letter[cell[a:b]]
        letter = letter.reshape(n, r) * factor[j]
        letter += shift[j]
        letter >>= np.uint32(31)
        at += letter.reshape(-1)
        np.minimum(at, end, out=at)
    return out.reshape(n, r, SAMPLED)


def agree(items: list[str], windows: list[str], repetitions: range) -> np.ndarray:
    """Whether all samples of one of the repetitions agree, for each pair of an item and a window."""
    out = np.zeros(len(items), bool)
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), PAIRS):
        own = order[at : at + PAIRS]
        used, which = np.unique(np.array([items[i] for i in own], object), return_inverse=True)
        known = embed(list(used), np.fromiter(map(len, used), np.int64, len(used)), repetitions)
        out[own] = (embed([windows[i] for i in own], sizes[own], repetitions) == known[which]).all(axis=2).any(axis=1)
    return out


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    """``text`` with substitutions, insertions and deletions at as many places."""
    letters = list(text)
    for at in sorted(rng.choice(len(text), edits, replace=False).tolist(), reverse=True):
        new = text[int(rng.integers(len(text)))]
        letters[at : at + 1] = [[new], [letters[at], new], []][int(rng.integers(3))]
    return "".join(letters)


def repetitions_for(texts: list[str], edits: float = EDITS, recall: float = RECALL, experiments: int = 120) -> int:
    """The number of repetitions that find a share of ``recall`` of items with the most edits allowed, followed by other text."""
    rng = np.random.default_rng(len(texts))
    pool = [t for t in texts if int(len(t) * edits)]
    if not pool:
        return FIRST
    items = [pool[int(i)] for i in rng.integers(len(pool), size=experiments)]
    items = [t[:2000] for t in items]  # the walk of a longer item is alike; only the experiment is cut
    windows = [edited(t, int(len(t) * edits), rng) + " " + pool[int(rng.integers(len(pool)))][: len(t)] for t in items]
    found, done = agree(items, windows, range(FIRST)), FIRST
    while found.mean() < recall and done < MOST:
        left = np.flatnonzero(~found)
        found[left] = agree([items[i] for i in left], [windows[i] for i in left], range(done, 2 * done))
        done *= 2
    return done


@dataclass
class Items:
    """The benchmark as the tasks use it; its size is that of one block of items."""

    ids: list
    texts: list[str]
    edits: float
    repetitions: int
    grams: np.ndarray = field(init=False)
    classes: list[tuple[int, int, int]] = field(init=False)

    def __post_init__(self) -> None:
        used = [i for i, text in enumerate(self.texts) if text]
        # Length classes: (least length, window, least number of q-grams that a match must have).
        self.classes = []
        class_of = {}
        lengths = sorted({len(self.texts[i]) for i in used})
        while lengths:
            low = lengths[0]
            own = [n for n in lengths if n <= low * 1.1]
            lengths = lengths[len(own) :]
            need = min(n - Q + 1 - Q * self.most(n) for n in own)
            class_of |= dict.fromkeys(own, len(self.classes))
            self.classes.append((low, own[-1] + self.most(own[-1]), need))
        # A group is a share of the items of a class; more groups than bits share bits, which only lets more pass.
        shares = max(BITS // max(len(self.classes), 1), 1)
        self.groups = [[(c * shares + k) % BITS for k in range(shares)] for c in range(len(self.classes))]
        self.group_of = {i: self.groups[class_of[len(self.texts[i])]][i % shares] for i in used}
        self.grams = np.zeros(1 << _TABLE_BITS, np.uint64)
        for i in used:
            points = np.frombuffer(self.texts[i].encode("utf-32-le"), "<u4")
            if len(points) >= Q:
                self.grams[_gram_hashes(points)] |= np.uint64(1 << self.group_of[i])
        self._index(used)

    def most(self, n: int) -> int:
        return int(n * self.edits)

    def _index(self, used: list[int]) -> None:
        """Places of the q-grams, sorted by hash, each item's least number of them, and pieces of items without one."""
        none = np.zeros(0, np.int64)
        hashes, items, places = [none], [none], [none]
        for i in used:
            points = np.frombuffer(self.texts[i].encode("utf-32-le"), "<u4")
            if len(points) >= Q:
                hashes.append(_gram_hashes(points).astype(np.int64))
                items.append(np.full(len(hashes[-1]), i))
                places.append(np.arange(len(hashes[-1])))
        h, item, place = (np.concatenate(x) for x in (hashes, items, places))
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        rare = n[inverse] <= COMMON
        left = np.bincount(item[rare], minlength=len(self.texts))
        self.need = {i: int(left[i]) - Q * self.most(len(self.texts[i])) for i in used}
        order = np.flatnonzero(rare)[np.argsort(h[rare], kind="stable")]
        self.index = h[order], item[order], place[order]
        self.pieces = {}
        for i in used:
            if self.need[i] <= 0:
                n_pieces = self.most(len(self.texts[i])) + 1
                edges = [len(self.texts[i]) * k // n_pieces for k in range(n_pieces + 1)]
                self.pieces[i] = [(a, self.texts[i][a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def bounded(self, text: str, hashes: np.ndarray, begins: np.ndarray, doc_ends: np.ndarray, chosen: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, int]]:
        """(word start, item): all pairs that may match, from the word starts and groups that ``candidates`` left."""
        for i, pieces in self.pieces.items():
            most = self.most(len(self.texts[i]))
            starts = set()
            for place, piece in pieces:
                at = text.find(piece)
                while at >= 0:
                    lo, hi = np.searchsorted(begins, (at - place - most, at - place + most + 1))
                    starts.update(w for w in range(lo, hi) if doc_ends[w] > at)
                    at = text.find(piece, at + 1)
            yield from ((w, i) for w in starts)
        if not len(hashes) or not len(chosen):
            return
        known, of, place = self.index
        near = np.zeros(len(text) + 1, np.int32)
        room = max(map(len, self.texts))
        np.add.at(near, begins[chosen], 1)
        np.add.at(near, np.minimum(begins[chosen] + 2 * room, len(text)), -1)
        hit = np.flatnonzero((self.grams[hashes] != 0) & (np.cumsum(near[: len(hashes)]) > 0))
        lo, hi = (np.searchsorted(known, hashes[hit].astype(np.int64), side) for side in ("left", "right"))
        n = hi - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        # Where the item would begin if nothing were edited before the q-gram.
        diagonal = np.repeat(hit, n) - place[entry] + room
        key = of[entry] << 40 | diagonal
        order = np.argsort(key)
        key, placed = key[order], place[entry][order]
        hits = np.bincount(of[entry], minlength=len(self.texts))
        for i in np.flatnonzero(hits).tolist():
            if not 0 < self.need[i] <= hits[i]:
                continue
            own = chosen[mask >> np.uint64(self.group_of[i]) & np.uint64(1) > 0]
            most, at = self.most(len(self.texts[i])), begins[own] + room
            lo = np.searchsorted(key, (i << 40) + np.maximum(at - most, 0))
            hi = np.searchsorted(key, (i << 40) + at + most + 1)
            # A text that repeats itself has a q-gram of the item many times; each counts once.
            for k in np.flatnonzero(hi - lo >= self.need[i]).tolist():
                if len(set(placed[lo[k] : hi[k]].tolist())) >= self.need[i]:
                    yield int(own[k]), i

    def candidates(self, hashes: np.ndarray, begins: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the word starts ``begins`` (in the text of which ``hashes`` has the q-grams; texts end at ``doc_ends``) may start a match, and the
        groups of items, as bits, that each of them may match."""
        mask = np.zeros(len(begins), np.uint64)
        for groups, (_, _, need) in zip(self.groups, self.classes, strict=True):
            if need <= 0:
                mask |= np.uint64(sum(1 << g for g in set(groups)))
        if len(hashes):
            marks = self.grams[hashes]
            hit = np.concatenate(([0], np.cumsum(marks != 0, dtype=np.int32)))
            marks = marks[marks != 0]
            # q-grams over a text's end belong to no window; they can only add hits.
            long = [(window, need) for _, window, need in self.classes if need > 0]
            begin = np.minimum(begins, len(hit) - 1).astype(np.int32)
            ends = np.minimum(doc_ends, len(hit) - 1).astype(np.int32)
            # First those that have enough for some class in the widest window.
            widest, fewest = max((w for w, _ in long), default=0), min((n for _, n in long), default=0)
            some = np.flatnonzero(hit[np.maximum(np.minimum(begin + np.int32(widest), ends), begin)] - hit[begin] >= fewest) if long else np.zeros(0, np.int64)
            begin, ends = begin[some], ends[some]
            first = hit[begin]
            for groups, (_, window, need) in zip(self.groups, self.classes, strict=True):
                if need <= 0:
                    continue
                last = hit[np.maximum(np.minimum(begin + np.int32(window), ends), begin)]
                left = np.flatnonzero(last - first >= need)
                if not len(left):
                    continue
                lo, hi = first[left], last[left]
                for g in groups:
                    own = np.concatenate(([0], np.cumsum(marks >> np.uint64(g) & np.uint64(1), dtype=np.int32)))
                    mask[some[left[own[hi] - own[lo] >= need]]] |= np.uint64(1 << g)
        chosen = np.flatnonzero(mask)
        return chosen, mask[chosen]

    def pairs(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, begin of the window) of the normal ``texts`` that the bound leaves."""
        docs = [t.split() for t in texts]
        flat = [w for d in docs for w in d]
        if not flat or not self.classes:
            return []
        text = "\n".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        sizes = np.fromiter(map(len, texts), np.int64, len(docs))
        doc_at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        word_sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        of = np.repeat(np.arange(len(docs)), counts)
        run = np.cumsum(word_sizes + 1) - word_sizes - 1
        begins = run - np.repeat(run[np.minimum(first, len(flat) - 1)], counts) + np.repeat(doc_at, counts)
        doc_ends = np.repeat(doc_at + sizes, counts)
        hashes = _gram_hashes(points) if len(points) >= Q else np.zeros(0, np.uint64)
        chosen, mask = self.candidates(hashes, begins, doc_ends)
        if not len(chosen):
            return []
        found = self.bounded(text, hashes, begins, doc_ends, chosen, mask)
        return [(int(of[w]), i, int(begins[w] - doc_at[of[w]])) for w, i in found]

    def closest(self, i: int, text: str, at: int) -> tuple[int, int, int] | None:
        """(distance, begin, end) of one window, if it is near enough."""
        item, most = self.texts[i], self.most(len(self.texts[i]))
        near = edit_distance_prefix(item, text[at : at + len(item) + most], most)
        return (near[0], at, at + near[1]) if near else None

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance), each passage once.

        The first repetitions are walked for all pairs, the others for windows that do not begin in a passage found.
        """
        docs = [" ".join(normal(t)) for t in texts]
        left: list[tuple[int, int, int]] = []
        at = 0
        while at < len(docs):
            end, size = at, 0
            while end < len(docs) and size < 1 << 20:
                size += len(docs[end]) + 1
                end += 1
            left += [(d + at, i, w) for d, i, w in self.pairs(docs[at:end])]
            at = end
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        taken: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for repetitions in (range(FIRST), range(FIRST, self.repetitions)):
            left = [(d, i, w) for d, i, w in left if not any(a <= w < b for _, a, b in taken.get((d, i), ()))]
            if not left or not len(repetitions):
                break
            items = [self.texts[i] for _, i, _ in left]
            said = agree(items, [docs[d][w : w + len(t)] for (d, _, w), t in zip(left, items, strict=True)], repetitions)
            for (d, i, w), yes in zip(left, said.tolist(), strict=True):
                near = self.closest(i, docs[d], w) if yes else None
                if near:
                    hits[d, i].append(near)
            left = [pair for pair, yes in zip(left, said.tolist(), strict=True) if not yes]
            for key, found in hits.items():
                taken[key] = []
                for distance, a, b in sorted(found):
                    if all(b <= x or a >= y for _, x, y in taken[key]):
                        taken[key].append((distance, a, b))
        out = []
        for (d, i), found in sorted(taken.items()):
            out += [(d, i, docs[d].count(" ", 0, a), docs[d].count(" ", a, b) + 1, distance) for distance, a, b in found]
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS, recall: float = RECALL, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each passage: id, item id, first_word, n_words, distance.

    The benchmark is taken in blocks of about so many items or characters, each of which is scanned for on its own.
    """
    spark = ready(docs)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("item"), blank(F.col(item_text)).alias("text")).distinct()
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).head()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    source = docs.select(F.col(id_col).alias(id_col), blank(F.col(text_col)).alias("text"))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        rows = sorted(((r["item"], " ".join(normal(r["text"]))) for r in rows), key=str)
        texts = [t for _, t in rows]
        shared = spark.sparkContext.broadcast(([i for i, _ in rows], texts, edits, repetitions_for(texts, edits, recall)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            bench = Items(*shared.value)
            for batch in batches:
                ids, texts = batch.columns
                cols = list(zip(*bench.search(texts.to_pylist()), strict=True)) or [()] * 5
                named = pa.array([bench.ids[i] for i in cols[1]], to_arrow_type(item_kind))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), named, *[pa.array(c, pa.int64()) for c in cols[2:]]], names=[id_col, "item_id", "first_word", "n_words", "distance"])

        part = source.mapInArrow(run, f"`{id_col}` {kind}, item_id {item_kind.simpleString()}, first_word bigint, n_words bigint, distance bigint")
        out = part if out is None else out.union(part)
    return out
