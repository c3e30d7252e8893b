"""Near-duplicates of a given shingle similarity by deletion-variant signatures of a long SimHash and a prefix join.

A text's fingerprint is the majority of the 256-bit hashes of its distinct words. Words change less than shingles: where
edits leave 0.8 of the five-word shingles, about 6 % of these bits differ, against 13 % of those of a fingerprint of the
shingles. The fingerprint is cut into eight segments. Up to 15 differing bits leave one that differs by at most one bit
for certain; at 6 % the chance is 0.98. Every segment is indexed with each of its bits wildcarded in turn, and equal keys
make groups. In a group a spanning forest links fingerprints that are near, from the one next to the group's majority on,
so that edited copies are compared with what they were made from. Each link is verified by the exact Jaccard similarity of
the two texts' sets of shingles, and verified links make the first classes.

Fingerprints and forests miss links, so all pairs of texts in different classes that can meet the similarity are found by
a prefix join, which is exact: in any one order of all shingles, two sets of similarity t share one of the first
``size - ceil(t * size) + 1`` of each, and what follows their first shared one is long enough for the overlap. Shingles
that a sample finds in many texts come last in the order, so groups stay small; a group within one class is left out.

Texts that share a rare passage make groups without being alike, and their pairs grow with the square of a group, so no
pairs are written. Three passes over the groups write a row for a text of a group at most. The first keeps the texts that
have a partner by size and place; groups of the same texts become one. The second keeps those that have one by sketches of
the sets: each shingle flips a bit, so sets differ in at least as many shingles as sketches in bits, and the sketch is as
long as the set is large. The third has the sets of the few that are left and gives the links of a forest among the classes
of each group, every link verified by the exact similarity; only pairs that verified links already join are left out.

Equal texts (lower-cased, by words) are one text throughout. Fingerprints' groups are read in parts, each of which takes
the last part's first fingerprint along, so memory does not grow with a group. The sets of a group wait in a local file.

Nulls: a null text is empty; all texts without a word are equal. Texts with fewer words than a shingle have one shingle.
Repeated rows share their class. Empty tables give empty results. Only the key and the text are read.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, broadcast_if_small, drop_table, materialize, ready
from .components import connected_components

BITS, SEGMENT = 256, 32
#: Differing bits from which two fingerprints are not compared any more: texts without relation differ in over 90.
NEAR = 56
#: Fingerprints of a group that are searched at once.
PART = 20_000
#: Words whose hashes a task remembers.
CACHE = 200_000
#: Texts of which shingles are counted for the order of the prefix join, and the commonest that come last. Any order is exact.
SAMPLE, COMMON = 20_000, 1 << 17
#: Pairs of a group that are looked at at once, and those of them between which classes are joined.
BLOCK, TURN = 1 << 20, 1 << 10
#: Bits of a sketch at least and at most.
LEAST_BITS, MOST_BITS = 64, 1 << 15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def signature(words: list[bytes], known: dict[bytes, bytes]) -> bytes:
    """The fingerprint: a bit is one if over half of the distinct words' hashes have it."""
    own = set(words)
    if not own:
        return bytes(BITS // 8)
    if len(known) + len(own) > CACHE:
        known.clear()
    digest = xxhash.xxh3_128_digest
    for w in own:
        if w not in known:
            known[w] = digest(w, 1) + digest(w, 2)
    counts = np.zeros(BITS, np.int64)
    hashes = np.frombuffer(b"".join([known[w] for w in own]) if len(own) <= CACHE else b"".join([digest(w, 1) + digest(w, 2) for w in own]), np.uint8).reshape(-1, BITS // 8)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    k = min(size, len(words))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)], np.uint64))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of two empty ones is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signatures(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            content, prints = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                content.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(signature(words, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(prints, pa.binary())], names=["key", "content", "print"])

    return rows.mapInArrow(run, f"key {kind}, content binary, print binary")


def variants(prints: np.ndarray) -> np.ndarray:
    """[print, variant]: each segment's number, the wildcarded bit's, and the other bits."""
    parts = prints.view("<u4").reshape(len(prints), BITS // SEGMENT).astype(np.int64)
    bits = np.arange(SEGMENT)
    label = (np.arange(BITS // SEGMENT)[:, None] * SEGMENT + bits) << 32
    return ((parts[:, :, None] & ~(1 << bits)) | label).reshape(len(prints), -1)


def _shared(dealt: DataFrame) -> DataFrame:
    """The rows (numbers, the first is ``group``) whose group has another row, sorted by the group."""
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        before = None

        def out(last: bool) -> pa.RecordBatch:
            """Rows whose group goes on before or after; the last one waits for what follows."""
            group = held[0]
            n = len(group) if last else len(group) - 1
            same = np.zeros(len(group) + 1, bool)
            same[1:-1] = group[1:] == group[:-1]
            same[0] = before is not None and group[0] == before
            keep = (same[:-1] | same[1:])[:n]
            return pa.RecordBatch.from_arrays([pa.array(x[:n][keep]) for x in held], names=names)

        for batch in batches:
            new = [x.to_numpy() for x in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(held[0]) > 1:
                yield out(False)
                before, held = held[0][-2], [x[-1:] for x in held]
        if held and len(held[0]):
            yield out(True)

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, dealt.schema)


def _groups(texts: DataFrame) -> DataFrame:
    """``group``, ``node`` of all texts that share a variant with another one."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                prints = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = variants(prints)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["group", "node"])

    return _shared(texts.select("node", "print").mapInArrow(spread, "group bigint, node bigint"))


def forest(prints: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """Links of a spanning forest among fingerprints (rows of 64-bit words) that differ in at most ``near`` bits.

    The search begins at the one next to the majority of those left; each leaves the search once it is reached.
    """
    links: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        ones = np.unpackbits(prints[rest].view(np.uint8), axis=1).sum(axis=0)
        middle = np.packbits(2 * ones > len(rest)).view(np.uint64)
        pivot = int(np.argmin(np.bitwise_count(prints[rest] ^ middle).sum(axis=1)))
        queue = [int(rest[pivot])]
        rest = np.delete(rest, pivot)
        while queue and len(rest):
            i = queue.pop(0)
            reach = np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1) <= near
            if reach.any():
                reached = rest[reach].tolist()
                links += [(i, j) for j in reached]
                queue += reached
                rest = rest[~reach]
    return links


def _links(groups: DataFrame, near: int) -> DataFrame:
    """``src``, ``dst``: forests of all groups (columns group, node, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, size = None, 0

        def decide(carry: bool) -> pa.RecordBatch:
            nonlocal size
            nodes, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            links = forest(prints, near)
            # A later part of the group meets this part's first centre.
            first = links[0][0] if links else 0
            held[:] = [(nodes[first : first + 1], prints[first : first + 1])] if carry else []
            size = len(held)
            pairs = [sorted((int(nodes[i]), int(nodes[j]))) for i, j in links]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            group, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if group[a] != current:
                    if size > 1:
                        yield decide(False)
                    held, current, size = [], group[a], 0
                for at in range(a, b, PART):
                    end = min(at + PART, b)
                    held.append((node[at:end], prints[at:end]))
                    size += end - at
                    if size >= PART:
                        yield decide(True)
        if size > 1:
            yield decide(False)

    dealt = groups.select("group", "node", "print").repartition("group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(run, "src bigint, dst bigint").where("src != dst").distinct()


def prefix_size(size: int, similarity: float) -> int:
    """Of sets that meet the similarity, one of so many first shingles is in the other's first ones."""
    return size - max(1, math.ceil(similarity * size - 1e-6)) + 1


def _sampled(own: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of the texts, sorted, and how many texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(words_of(text.as_py()), shingle).view(np.int64))], names=["group"])

    some = own.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).mapInArrow(run, "group bigint")
    found = some.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "group").limit(COMMON).toArrow()
    group, count = found["group"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(group)
    return group[order], count[order]


def _prefixes(own: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``group`` (a shingle of the prefix), ``id`` (a hash of the content), ``size`` of the set, ``pos`` in its order."""
    known, count = common

    def rows_of(text: str | None) -> list[np.ndarray]:
        words = words_of(text)
        own = shingles(words, shingle)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            own = own[np.lexsort((own, np.where(known[at] == own, count[at], 0)))]
        first = own[: prefix_size(len(own), similarity)].view(np.int64)
        name = np.uint64(xxhash.xxh64_intdigest(xxhash.xxh3_128_digest(b" ".join(words)), 42)).astype(np.int64)
        return [first, np.full(len(first), name), np.full(len(first), len(own), np.int32), np.arange(len(first), dtype=np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [rows_of(t.as_py()) for t in batch.column(1).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["group", "id", "size", "pos"])

    return own.mapInArrow(run, "group bigint, id bigint, size int, pos int")


def sketch(own: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes, one if an odd number of them has it; bits are a power of two."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(own) - 1).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def group_pairs(root: np.ndarray, size: np.ndarray, pos: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs (by rising size) of different roots whose sizes and places of the shared shingle allow the similarity."""
    n, at = len(root), 0
    ends = np.searchsorted(size, size / similarity + 1e-6, side="right")
    left = size - pos
    while at < n - 1:
        step = max(1, BLOCK // max(1, int(ends[at]) - at))
        step = max(1, BLOCK // max(1, int(ends[min(at + step, n) - 1]) - at))
        i = np.arange(at, min(at + step, n))[:, None]
        j = np.arange(at + 1, int(ends[i[-1, 0]]))[None, :]
        at += step
        if not j.size:
            continue
        enough = np.minimum(left[i], left[j]) >= (size[i] + size[j]) * (similarity / (1 + similarity)) - 1e-6
        a, b = np.nonzero((j > i) & (root[i] != root[j]) & enough)
        if len(a):
            yield i[a, 0], j[0, b]


def sketches_allow(sketches: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of places may meet the similarity; the longer sketch is folded to the other's bits."""
    words = np.array([len(x) // 8 for x in sketches])
    shorter = np.minimum(words[i], words[j])
    most = (size[i] + size[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
    keep = np.zeros(len(i), bool)
    for w in np.unique(shorter).tolist():
        at = np.flatnonzero(shorter == w)
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[k], np.uint64).reshape(-1, w), axis=0) for k in used.tolist()])
        x, y = place[: len(at)], place[len(at) :]
        step = max(1, BLOCK // w)
        for k in range(0, len(at), step):
            differ = np.bitwise_count(table[x[k : k + step]] ^ table[y[k : k + step]]).sum(axis=1)
            keep[at[k : k + step]] = differ <= most[at[k : k + step]]
    return keep


def _by_group(batches: Iterator[pa.RecordBatch], hold: Callable[..., list[np.ndarray]] = lambda *columns: list(columns)) -> Iterator[list[np.ndarray]]:
    """The other columns of each run of equal values of the first one, as ``hold`` keeps them."""
    held: list[list[np.ndarray]] = []
    current = None
    for batch in batches:
        group, *rest = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and group[a] != current:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            current = group[a]
            held.append(hold(*[x[a:b] for x in rest]))
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _dealt(groups: DataFrame, *columns: str) -> DataFrame:
    return groups.select(*columns).repartition("group").sortWithinPartitions("group", "size", "node")


_LEFT = "group bigint, node bigint, root bigint, size int"


def _left(node: np.ndarray, root: np.ndarray, size: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
    """The rows of those that have a partner. Their group is named by them, so groups of the same texts become one."""
    name = np.uint64(xxhash.xxh64_intdigest(np.sort(node[has]).tobytes())).astype(np.int64)
    columns = [np.full(int(has.sum()), name), node[has], root[has], size[has].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["group", "node", "root", "size"])


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some thousand rows of many small ones."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= 1 << 13:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(1 << 16)
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(1 << 16)


def _by_place(groups: DataFrame, similarity: float) -> DataFrame:
    """Texts of groups (columns group, node, root, size, pos) that may be alike to one of another class by size and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, root, size, pos in _by_group(batches):
            if (root == root[0]).all():
                continue
            has = np.zeros(len(node), bool)
            for i, j in group_pairs(root, size.astype(np.int64), pos, similarity):
                has[i] = has[j] = True
            if has.any():
                yield _left(node, root, size, has)

    return _dealt(groups, "group", "node", "root", "size", "pos").mapInArrow(lambda x: _joined(run(x)), _LEFT).distinct()


def _by_sketch(groups: DataFrame, similarity: float) -> DataFrame:
    """Texts of groups (columns group, node, root, size, made) that may be alike to one of another class by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, root, size, made in _by_group(batches):
            size, has = size.astype(np.int64), np.zeros(len(node), bool)
            for i, j in group_pairs(root, size, np.zeros_like(size), similarity):
                keep = sketches_allow(made, size, i, j, similarity)
                has[i[keep]] = has[j[keep]] = True
            if has.any():
                yield _left(node, root, size, has)

    return _dealt(groups, "group", "node", "root", "size", "made").mapInArrow(lambda x: _joined(run(x)), _LEFT).distinct()


def class_links(root: np.ndarray, size: np.ndarray, sketches: np.ndarray, set_of: Callable[[int], np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Places of pairs that meet the similarity: a spanning forest of the roots that all such pairs of the group join."""
    label = root.copy()
    for i, j in group_pairs(label, size, np.zeros_like(size), similarity):
        keep = sketches_allow(sketches, size, i, j, similarity)
        i, j = i[keep], j[keep]
        for at in range(0, len(i), TURN):
            a, b = i[at : at + TURN], j[at : at + TURN]
            apart = label[a] != label[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                if label[x] != label[y] and similarity_of(set_of(x), set_of(y)) >= similarity:
                    label[label == label[y]] = label[x]
                    yield x, y


def _by_set(groups: DataFrame, similarity: float) -> DataFrame:
    """``src``, ``dst``: links of groups (columns group, node, root, size, made) between classes, verified by the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:

            def hold(node: np.ndarray, root: np.ndarray, size: np.ndarray, made: np.ndarray) -> list[np.ndarray]:
                start, short = np.empty(len(node), np.int64), np.empty(len(node), object)
                for k, own in enumerate(made):
                    start[k] = file.tell()
                    file.write(own)
                    short[k] = sketch(np.frombuffer(own, np.uint64))
                return [node, root, size.astype(np.int64), start, short]

            for node, root, size, start, short in _by_group(batches, hold):

                def set_of(k: int, start: np.ndarray = start, size: np.ndarray = size) -> np.ndarray:
                    file.seek(int(start[k]))
                    return np.frombuffer(file.read(8 * int(size[k])), np.uint64)

                pairs = [sorted((int(node[x]), int(node[y]))) for x, y in class_links(root, size, short, set_of, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])
                file.seek(0)
                file.truncate()

    return _dealt(groups, "group", "node", "root", "size", "made").mapInArrow(run, "src bigint, dst bigint").distinct()


def _made(nodes: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, of: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """``node``, ``made``: what ``of`` makes of the set of shingles, for the distinct nodes of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(shingles(words_of(t.as_py()), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "made"])

    used = nodes.select("node").distinct().join(texts.select("node", "least"), "node")
    own = rows.join(used, F.col("key") == F.col("least")).select("node", "text")
    return materialize(own.mapInArrow(run, "node bigint, made binary"), name)


def _verified(links: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a written table, which is deleted) whose texts' sets of shingles have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            as_set = lambda x: np.frombuffer(x.as_py(), np.uint64)
            keep = [similarity_of(as_set(a), as_set(b)) >= similarity for a, b in pairs]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = _made(links.select(F.col("src").alias("node")).union(links.select("dst")), rows, texts, shingle, np.ndarray.tobytes, "near-sets")
    both = links.join(own.select(F.col("node").alias("src"), F.col("made").alias("a")), "src")
    both = both.join(own.select(F.col("node").alias("dst"), F.col("made").alias("b")), "dst")
    sure = materialize(both.select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint"), "near-verified")
    drop_table(own)
    drop_table(links)
    return sure


def _left_out(rows: DataFrame, marked: DataFrame, texts: DataFrame, member: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``src``, ``dst``: pairs of texts that meet the similarity, which join all classes (``member``) that any such pair joins."""
    copies = marked.join(texts.select("content", "least"), "content").where("key != least").select(F.col("key").alias("copy"))
    own = rows.join(broadcast_if_small(materialize(copies, "near-copies")), F.col("key") == F.col("copy"), "left_anti")
    common = _sampled(own, texts.count(), shingle)
    found = materialize(_shared(_prefixes(own, shingle, similarity, common)), "near-prefixes")
    named = texts.select("node", F.xxhash64("content").alias("id")).join(member.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    named = named.select("id", "node", F.coalesce("root", "node").alias("root"))
    left = materialize(_by_place(found.join(named, "id"), similarity), "near-by-place")
    drop_table(found)
    for step, of, name in ((_by_sketch, sketch, "near-by-sketch"), (_by_set, np.ndarray.tobytes, "near-more")):
        own = _made(left, rows, texts, shingle, of, f"{name}-made")
        after = materialize(step(left.join(own, "node"), similarity), name)
        drop_table(own)
        drop_table(left)
        left = after
    return left


def near_duplicates(docs: DataFrame, key: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, near: int = NEAR) -> DataFrame:
    """``key`` (a column without nulls or repeats) and ``class_id``: the smallest key of those that links reach."""
    ready(docs)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), blank(F.col(f"`{text_col}`")).alias("text"))
    marked = materialize(_signatures(rows, kind), "near-signatures")
    texts = marked.groupBy("content").agg(F.min("key").alias("least"), F.first("print").alias("print"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("node"), "content", "least", "print"), "near-texts")
    shared = materialize(_groups(texts), "near-groups")
    links = materialize(_links(shared.join(texts.select("node", "print"), "node"), near), "near-links")
    drop_table(shared)
    member = connected_components(_verified(links, rows, texts, shingle, similarity))
    more = _left_out(rows, marked, texts, member, shingle, similarity)
    if more.head(1):
        member = connected_components(more.union(member.select("node", "root")))
    member = member.withColumnRenamed("node", "member")
    named = texts.join(member, F.col("node") == F.col("member"), "left").select("content", "least", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = materialize(named.join(best, "root").select("content", "class_id"), "near-classes")
    return marked.join(classes, "content").select(F.col("key").alias(key), "class_id")
