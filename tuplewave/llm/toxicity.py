"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel compares two words by their common subsequences of three characters, contiguous or not, within a span of
six; a gap costs a factor for each character passed over, so inserted or changed characters only weaken a match.
The kernel has an explicit feature space of 32**3 subsequences, so the machine trained on the landmarks' kernel
values is one weight for each subsequence, and a word is scored without visiting the landmarks.

The machine is trained on sentences, each of which stands for the word that it finds most toxic. A sentence of a clean
document must be clean. Of a toxic document only the document is labelled: those of its sentences must be toxic whose word
is far more frequent in toxic documents' sentences, and where there is none, the one that the fit before finds most
toxic, if it does. Fits and choices take turns, and clean sentences that violate the margin join until none is left or ``ROUNDS`` are done. Toxic words also
stand there with a letter inserted. Training takes a bounded sample of labelled documents, whole (``sample_docs`` of each class).
A document's score is that of its most toxic sentence, calibrated on the sample's documents.

Nulls: a null text is empty; texts without a word get the lowest score. Null labels and ids are not learnt from.
Without labels of both kinds every score is zero. Repeated rows are scored one by one; repeated labels count as one
if they agree, toxic if not. Words of any length are scored whole. Empty tables give empty results. Only the id and the
text are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, materialize, ready

SPAN, DECAY = 6, 0.6
CODE_BITS = 5
FEATURES = 1 << 3 * CODE_BITS
#: Labelled documents of each class in the training sample; landmarks; turns of choosing and fitting.
SAMPLE_DOCS, LANDMARKS, ROUNDS = 4000, 600, 3
#: Violating sentences' words that join the fit in one turn.
STEP = 4000
#: Words whose scores a task remembers; a word of more bytes is scored on its own, in parts of its subsequences.
CACHE, LONG_WORD = 400_000, 4096
LEAST = -4.0

_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPLIT_UP = re.compile(rb"(?<!\S)[a-z](?: [a-z]){2,}(?!\S)")


def _codes() -> np.ndarray:
    table = np.full(256, 27, np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[128:] = 28 + np.arange(128) % 4
    return table


_CODE = _codes()


def words_of(text: str | None) -> set[bytes]:
    """Lower-cased words without ASCII punctuation; runs of single letters also count as one word."""
    data = (text or "").lower().encode().translate(None, _DROP)
    words = set(data.split())
    for run in _SPLIT_UP.findall(data):
        words.add(run.replace(b" ", b""))
    return words


def sentences_of(text: str | None) -> list[set[bytes]]:
    return [words_of(s) for s in re.split(r"[.!?\n]+(?=\s|$)", text or "")]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all words; each word begins and ends with a boundary, and has norm one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), sizes)
    codes = _CODE[np.frombuffer(b"\0" + b"\0\0".join(words) + b"\0", np.uint8)] if words else np.zeros(0, np.int64)
    edges = np.cumsum(sizes)
    codes[edges - 1] = 0
    codes[edges - sizes] = 0
    keys, weights = [], []
    for end in range(2, SPAN):
        n = len(codes) - end
        if n <= 0:
            break
        inside = np.flatnonzero(of[:n] == of[end:])
        outer = of[inside] << 3 * CODE_BITS | codes[inside] << 2 * CODE_BITS | codes[inside + end]
        for mid in range(1, end):
            keys.append(outer | codes[inside + mid] << CODE_BITS)
            weights.append(np.full(len(inside), DECAY ** (end - 2)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate(keys)
    order = np.argsort(key)
    key, weight = key[order], np.concatenate(weights)[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    weight = np.add.reduceat(weight, cut)
    key = key[cut]
    word = key >> 3 * CODE_BITS
    norm = np.sqrt(np.bincount(word, weight * weight, len(words)))
    return word, key & (FEATURES - 1), weight / norm[word]


def kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Normalised kernel values of all pairs (for tests and for landmarks)."""
    return _matrix(a) @ _matrix(b).T


def _matrix(words: list[bytes]) -> np.ndarray:
    word, feature, weight = features(words)
    out = np.zeros((len(words), FEATURES), np.float32)
    out[word, feature] = weight
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    slope: float = 4.0
    shift: float = 0.0

    def long(self, word: bytes) -> float:
        """One word of any length; its subsequences are summed part by part, so arrays stay small."""
        codes = np.concatenate(([0], _CODE[np.frombuffer(word, np.uint8)], [0]))
        sums = np.zeros(FEATURES)
        for at in range(0, len(codes), 1 << 16):
            part = codes[at : at + (1 << 16) + SPAN - 1]
            for end in range(2, SPAN):
                n = min(len(part) - end, 1 << 16)
                for mid in range(1, end if n > 0 else 1):
                    key = part[:n] << 2 * CODE_BITS | part[mid : mid + n] << CODE_BITS | part[end : end + n]
                    sums += np.bincount(key, minlength=FEATURES) * DECAY ** (end - 2)
        norm = np.sqrt((sums * sums).sum())
        return float(sums @ self.weights / norm + self.bias) if norm else self.bias

    def decide(self, words: list[bytes]) -> np.ndarray:
        if any(len(w) > LONG_WORD for w in words):
            short = [w for w in words if len(w) <= LONG_WORD]
            known = dict(zip(short, self.decide(short).tolist(), strict=True))
            return np.array([known[w] if w in known else self.long(w) for w in words])
        out = np.zeros(len(words))
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            word, feature, weight = features(part)
            out[at : at + len(part)] = np.bincount(word, weight * self.weights[feature], len(part))
        return out + self.bias

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (decisions - self.shift), -30, 30)))


class Machine:
    """Squared-hinge machine on Nyström features, by Newton steps. Landmarks are the most frequent words of each class of
    the first fit. Each word weighs as often as it was seen (its root among the negative ones), both classes the same."""

    def __init__(self, positive: dict[bytes, int], negative: dict[bytes, int], landmarks: int = LANDMARKS) -> None:
        often = lambda words, n: sorted(words, key=lambda w: (-words[w], w))[:n]
        marks = often(positive, landmarks // 2)
        marks += often(negative, landmarks - len(marks))
        self.base = np.zeros((FEATURES, len(marks)), np.float32)
        word, feature, weight = features(marks)
        self.base[feature, word] = weight
        values, vectors = np.linalg.eigh((self.base.T @ self.base).astype(np.float64))
        keep = values > 1e-6 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])
        self.known: dict[bytes, np.ndarray] = {}
        self.beta = np.zeros(self.root.shape[1] + 1)

    def mapped(self, words: list[bytes]) -> np.ndarray:
        """Nyström features: kernel values with the landmarks, whitened; the last one is always 1."""
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 128):
            part = new[at : at + 128]
            word, feature, weight = features(part)
            kernels = np.zeros((len(part), self.base.shape[1]), np.float32)
            if len(word):
                cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                kernels[word[cut]] = np.add.reduceat(self.base[feature] * weight[:, None].astype(np.float32), cut, axis=0)
            self.known.update(zip(part, (kernels @ self.root).astype(np.float32), strict=True))
        out = np.ones((len(words), self.root.shape[1] + 1), np.float32)
        for row, w in zip(out, words, strict=True):
            row[:-1] = self.known[w]
        return out

    def fit(self, positive: dict[bytes, int], negative: dict[bytes, int], cost: float = 300.0, rounds: int = 60) -> Scorer:
        words = [*positive, *negative]
        z = self.mapped(words)
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        seen = np.concatenate((np.fromiter(positive.values(), float), np.sqrt(np.fromiter(negative.values(), float))))
        c = cost * seen / np.where(y > 0, seen[y > 0].sum(), seen[y < 0].sum())
        ridge = np.ones(z.shape[1])
        ridge[-1] = 1e-3
        beta = self.beta  # of the fit before
        loss = lambda w: ridge @ (w * w) + c @ np.maximum(1 - y * (z @ w), 0) ** 2
        now = loss(beta)
        for _ in range(rounds):
            active = np.flatnonzero(y * (z @ beta) < 1)
            both, right = np.diag(ridge), np.zeros(len(ridge))
            for at in range(0, len(active), 2048):  # in blocks, so that only they are held in double precision
                own = active[at : at + 2048]
                part = z[own].astype(np.float64)
                both += (part * c[own, None]).T @ part
                right += part.T @ (c[own] * y[own])
            step = np.linalg.solve(both, right) - beta
            size = 1.0
            while size > 1e-4 and loss(beta + size * step) >= now:
                size /= 2
            new = loss(beta + size * step)
            if new >= now * (1 - 1e-6):
                break
            beta, now = beta + size * step, new
        self.beta = beta
        return Scorer((self.base @ (self.root @ beta[:-1]).astype(np.float32)).astype(np.float64), float(beta[-1]))


def inserted(words: dict[bytes, int]) -> dict[bytes, int]:
    """Each word with one more letter, as disguised insults have, seen a quarter as often."""
    out: dict[bytes, int] = {}
    for i, w in enumerate(sorted(words, key=lambda w: (-words[w], w))):
        for at in {1, len(w) // 2, len(w) - 1}:
            out[w[:at] + b"aeioxstm"[(i + at) % 8 :][:1] + w[at:]] = max(1, words[w] // 4)
    return out


class Bags:
    """The distinct words of sentences, and for each sentence its words and its document."""

    def __init__(self, documents: Iterable[list[set[bytes]]]) -> None:
        """The sets are read one document at a time; what is held has four bytes for each word of a sentence."""
        known: dict[bytes, int] = {}
        words, sizes, of = array("i"), array("i"), array("i")
        for d, sentences in enumerate(documents):
            for own in sentences:
                if own:
                    words.extend([known.setdefault(w, len(known)) for w in sorted(own)])
                    sizes.append(len(own))
                    of.append(d)
        self.words, self.document = list(known), np.frombuffer(of, np.int32) if of else np.zeros(0, np.int32)
        self.word = np.frombuffer(words, np.int32) if words else np.zeros(0, np.int32)
        sizes = np.array(sizes, np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def most(self, value: np.ndarray) -> np.ndarray:
        """For each sentence its word with the highest value, the first of equals in the order of words."""
        own = value.astype(np.float32)[self.word]
        at_top = own == np.maximum.reduceat(own, self.begins)[self.sentence]
        return np.minimum.reduceat(np.where(at_top, self.word, len(self.words)), self.begins)


def fit_sentences(documents: Iterable[list[set[bytes]]], toxic: np.ndarray, rounds: int = ROUNDS, step: int = STEP, **options) -> Scorer | None:
    """The machine of ``documents`` (lists of sentences, which are sets of words; one for each of ``toxic``); None if nothing tells the classes apart."""
    bags = Bags(documents)
    if not len(bags.begins):
        return None
    bad = toxic[bags.document].astype(bool)
    seen = [np.bincount(bags.word[m[bags.sentence]], minlength=len(bags.words)).astype(float) for m in (~bad, bad)]
    n = [max(int((~bad).sum()), 1), max(int(bad.sum()), 1)]
    # Rates of sentences; the toxic one is taken 1.5 standard errors low, so that chance finds weigh little.
    value = np.log(np.maximum(seen[1] - 1.5 * np.sqrt(seen[1]), 1e-3) / n[1]) - np.log((seen[0] + 0.3) / n[0])
    firm = value >= np.log(6.0)
    # What clean sentences have about as often is no insult, whatever a fit says.
    open_to = seen[1] / n[1] > 3 * (seen[0] + 0.3) / n[0]
    chosen, scorer, machine = np.zeros(len(bags.words)), None, None
    for turn in range(rounds):
        best = bags.most(value)
        hit = bad & firm[best]
        if machine is not None:
            # A document without such a sentence stands for the one that the fit finds most toxic, if it is.
            told = np.zeros(len(toxic), bool)
            told[bags.document[hit]] = True
            fits = bad & ~told[bags.document] & (value[best] > 0) & open_to[best]
            top = np.full(len(toxic), -np.inf)
            np.maximum.at(top, bags.document[fits], value[best[fits]])
            hit |= fits & (value[best] == top[bags.document])
        positive = np.bincount(best[hit], minlength=len(bags.words))
        # Clean sentences that violate the margin, the worst words first; they stay in the fit once they are chosen.
        clean = np.bincount(best[~bad], minlength=len(bags.words))
        order = np.lexsort((np.arange(len(clean)), -value))
        order = order[(clean[order] > 0) & (chosen[order] == 0) & (positive[order] == 0)]
        new = order[:step] if scorer is None else order[value[order] > -1][:step]
        if scorer is None:  # besides the worst ones, others that stand for the words as they are
            new = np.union1d(new, order[np.argsort([zlib.crc32(bags.words[i]) for i in order], kind="stable")[:step]])
        chosen[new] = clean[new]
        chosen[positive > 0] = 0
        if not positive.any() or not chosen.any() or (turn and not len(new)):
            break
        words = lambda of: {bags.words[i]: int(of[i]) for i in np.flatnonzero(of)}
        toxic_words = inserted(words(positive)) | words(positive)
        machine = machine or Machine(toxic_words, words(chosen), **options)
        scorer = machine.fit(toxic_words, words(chosen))
        if turn + 1 < rounds:
            value = scorer.decide(bags.words)
    return scorer


def calibrate(scorer: Scorer, decisions: np.ndarray, labels: np.ndarray, rounds: int = 50) -> None:
    """Logistic fit of the documents' decisions (Platt), with a little ridge so that separable data stay finite."""
    x = np.column_stack((decisions, np.ones(len(decisions))))
    share = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((labels == 0).sum(), 1)) * len(labels)
    w = np.array([4.0, 0.0])
    prior = np.array([4.0, 0.0])

    def loss(v: np.ndarray) -> float:
        return share @ np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ v)) + 0.5 * ((v - prior) ** 2).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - labels)) + (w - prior)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    if w[0] > 0.1:
        scorer.slope, scorer.shift = float(w[0]), float(-w[1] / w[0])


def _decisions(docs: DataFrame, scorer: Scorer, extra: list[str], out: str) -> DataFrame:
    """``extra`` columns and ``out``: the decision of the most toxic word of ``text``, at least ``LEAST``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        model = shared.value
        for batch in batches:
            texts = batch.column(len(extra))
            best: list[float] = []
            for at in range(0, batch.num_rows, 256):
                words = [words_of(t) for t in texts.slice(at, 256).to_pylist()]
                new = [w for w in set().union(*words) if w not in known]
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(set().union(*words))
                known.update(zip(new, model.decide(new).tolist(), strict=True))
                best += [max(map(known.__getitem__, s), default=LEAST) for s in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], pa.array(np.maximum(best, LEAST) if best else np.zeros(0))], names=[*extra, out])

    return docs.select(*extra, "text").mapInArrow(run, f"{kinds}, {out} double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """``labels`` are those to learn from. The sample is the ``sample_docs`` documents of each class with the smallest hash."""
    ready(docs)
    known = labels.select(F.col(label_id).alias("label_id"), F.col(label).cast("int").alias("y")).where("label_id is not null and y in (0, 1)")
    known = known.groupBy("label_id").agg(F.max("y").alias("y"))
    own = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_docs)
    ids = materialize(own(1).union(own(0)), "toxic-ids")  # at most two classes of sample_docs rows
    rows = docs.select(F.col(id_col).alias("id"), blank(F.col(text_col)).alias("text"))
    sample = materialize(rows.join(F.broadcast(ids), rows["id"] == ids["label_id"]).select("id", "y", "text"), "toxic-sample")

    got = sample.select("y", "text").toArrow()
    y = got["y"].to_numpy().astype(np.int64)
    scorer = fit_sentences((sentences_of(t.as_py()) for t in got["text"]), y) if len(set(y.tolist())) == 2 else None
    del got
    if scorer is None:
        return Scorer(np.zeros(FEATURES), -1.0, 30.0, 1.0)
    got = _decisions(sample, scorer, ["y"], "d").toArrow()
    calibrate(scorer, got["d"].to_numpy(), got["y"].to_numpy().astype(np.float64))
    return scorer


def held_out(id_col: Column) -> Column:
    """The third of the ids that nothing is learnt from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """Id, ``score`` from 0 to 1, ``predicted`` (1 from ``threshold`` on)."""
    ready(docs)
    scorer = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias(id_col), blank(F.col(text_col)).alias("text"))
    logit = F.lit(scorer.slope) * (F.col("d") - F.lit(scorer.shift))
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    return _decisions(rows, scorer, [id_col], "d").select(id_col, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
