"""URL filtering by association rules over URL tokens.

Transactions are the tokens of labelled URLs plus a label item. Tokens that are in the same transactions are one item.
Spark's FP-growth finds all itemsets; where a transaction has more than ``MOST_ITEMS`` items these would be too many, and
the same rules are found level by level instead, over whole transactions: only sets that a URL to be judged has, that can
still reach the confidence, and of which each item leaves out a wrong case that the others let in. Sets without that are
redundant, and so is all that contains them. Rules ``tokens -> label`` are pruned by support, by confidence (corrected for
few cases, by one formula at every size) and by redundancy, and an inverted index from each rule's rarest token finds the
rules of a URL.

Without labels of URLs those on which a listed rule decides are the labelled ones. The tokens that the list names are
then hidden from mining, so that what is learnt is not the list itself.

Nulls and URLs without ``://`` have an empty host and path, fit no listed rule and have no host tokens; null labels are not
learnt from. Repeated rows are judged one by one and learnt from one by one. An empty table gives an empty result, and
without labelled URLs the default verdict holds. Ties between rules of equal confidence and support go to the one with
more, then smaller tokens. Only the id and the url are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, drop_table, materialize, ready

#: Items of a transaction up to which FP-growth is used: it finds no more than 2**12 itemsets in one.
MOST_ITEMS = 12
LABEL = "label="


@dataclass(frozen=True)
class ListRule:
    """A listed rule: it fits ``host`` and all its subdomains when the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    label: str
    confidence: float
    support: float


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return blank(lower), blank(path)


def listed(rules: list[ListRule], host: Column, path: Column) -> Column:
    """The longest listed rule that fits, as a struct, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct items: scheme, words of the host, path segments, extension, query keys.

    Runs of digits become ``0``, so identifiers do not make items of their own.
    """
    plain = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    tag = lambda name, array: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(name + ":"), x))
    scheme = F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    words = F.split(plain(host), r"[.-]")
    segments = F.split(plain(F.lower(path)), r"[/.]")
    query = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    parts = [tag("scheme", scheme), tag("host", words), tag("path", segments), tag("key", query)]
    return F.array_distinct(F.concat(*parts))


def named_tokens(rules: list[ListRule]) -> list[str]:
    """The items that the listed rules decide by."""
    hosts = {f"host:{x}" for r in rules for x in re.split(r"[.-]", r.host) if x}
    return sorted(hosts | {f"path:{x}" for r in rules for x in re.split(r"[/.]", r.path.lower()) if x})


def _items(labelled: DataFrame, n: int, min_support: float) -> list[tuple[str, list[str]]]:
    """Frequent items, the most telling first (the order changes no rule), each with the tokens that are in the same transactions.

    There are at most as many as tokens in a URL on average, divided by the support, whatever the size of the table.
    """
    one = labelled.select(F.explode("items").alias("item"), "label", F.xxhash64("items", "label").alias("h"))
    # Equal sums of the transactions' hashes, with equal counts, mean the same transactions.
    stats = one.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.count_if(F.col("label") == "block").alias("block"))
    rows = stats.where(F.col("n") >= min_support * n).collect()
    blocked = labelled.where("label = 'block'").count() / n
    same: dict[tuple, list[str]] = defaultdict(list)
    for r in rows:
        same[r["n"], r["h"], r["block"]].append(r["item"])
    telling = lambda key: abs(key[2] - blocked * key[0]) / math.sqrt(key[0])
    ranked = sorted(same.items(), key=lambda x: (-telling(x[0]), min(x[1])))
    return [(min(tokens), sorted(tokens)) for _, tokens in ranked]


def _counts(base: DataFrame, sets: list[tuple[int, ...]]) -> dict[tuple[int, ...], dict[str | None, int]]:
    """How many rows (columns places, label, n) of each label have all items of a set; the sets are of one size."""
    size, number = len(sets[0]), {own: i for i, own in enumerate(sets)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[tuple[int, str | None], int] = defaultdict(int)
            for places, label, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if math.comb(len(places), size) <= len(sets):
                    held = [i for own in combinations(places, size) if (i := number.get(own)) is not None]
                else:
                    whole = set(places)
                    held = [i for i, own in enumerate(sets) if whole.issuperset(own)]
                for i in held:
                    totals[i, label] += n
            columns = zip(*((i, label, n) for (i, label), n in totals.items()), strict=True) if totals else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["i", "label", "n"])

    out: dict[tuple[int, ...], dict[str | None, int]] = {own: {} for own in sets}
    for r in base.mapInArrow(run, "i long, label string, n long").groupBy("i", "label").agg(F.sum("n").alias("n")).collect():
        out[sets[r["i"]]][r["label"]] = r["n"]
    return out


def _by_levels(base: DataFrame, items: int, n: int, min_support: float, min_confidence: float, judged: bool) -> list[tuple[tuple[int, ...], str, int, int]]:
    """Items, label, right and fitting cases of all rules that are not redundant, and some that are.

    A rule that is not redundant is more confident than any with an item less. It is right no more often, so it is wrong
    less often; the same holds for all its parts. A label with no wrong case left cannot become more confident.
    """
    rules = []
    before: dict[tuple[int, ...], dict[str, int]] = {}
    sets = [(i,) for i in range(items)]
    while sets:
        # Of each set the wrong cases of the labels that larger sets may have.
        level: dict[tuple[int, ...], dict[str, int]] = {}
        for own, found in _counts(base, sets).items():
            if judged and not found.pop(None, 0):
                continue
            fits = sum(found.values())
            parts = [own[:i] + own[i + 1 :] for i in range(len(own))] if len(own) > 1 else []
            for label, right in found.items():
                wrong = fits - right
                if right < min_support * n or (right + 1) / (right + 2) < min_confidence or any(wrong >= before[x].get(label, 0) for x in parts):
                    continue
                if (right + 1) / (fits + 2) >= min_confidence:
                    rules.append((own, label, right, fits))
                if wrong:
                    level.setdefault(own, {})[label] = wrong
        follow: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for own in sorted(level):
            follow[own[:-1]].append(own[-1])
        sets = []
        for head, tails in follow.items():
            for own in (head + pair for pair in combinations(tails, 2)):
                parts = [level.get(x, {}) for x in combinations(own, len(own) - 1)]
                if set(parts[0]).intersection(*parts[1:]):
                    sets.append(own)
        before = level
    return rules


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9, most_items: int = MOST_ITEMS, judged: DataFrame | None = None) -> list[MinedRule]:
    """Rules from ``items`` and ``label``; the confidence is (right + 1) / (fitting + 2). Rules that a shorter one with the
    same label and at least its confidence covers are left out. Where a transaction has more than ``most_items`` items,
    rules that fit no ``items`` of ``judged`` may be left out too."""
    from pyspark.ml.fpm import FPGrowth

    n = labelled.count()
    ranked = _items(labelled, n, min_support) if n else []
    if not ranked:
        return []
    order = F.create_map(*[F.lit(x) for i, (item, _) in enumerate(ranked) for x in (item, i)])
    places = F.array_sort(F.filter(F.transform("items", lambda t: F.try_element_at(order, t)), lambda i: i.isNotNull()))
    if labelled.agg(F.max(F.size(places))).head()[0] <= most_items:
        names = F.array(*[F.lit(item) for item, _ in ranked])
        tokens = F.transform(places, lambda i: F.get(names, i))
        baskets = labelled.select(F.array_append(tokens, F.concat(F.lit(LABEL), "label")).alias("items"))
        sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets
        is_label = lambda x: x.startswith(LABEL)
        sets = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"), F.try_element_at(F.filter("items", is_label), F.lit(1)).alias("label"), "freq")
        whole = sets.where("label is null").select("tokens", F.col("freq").alias("n"))
        confidence = (F.col("freq") + 1) / (F.col("n") + 2)
        rules = sets.where("label is not null and size(tokens) > 0").join(whole, "tokens").select("tokens", "label", confidence.alias("confidence"), (F.col("freq") / n).alias("support"))
        found = [(tuple(sorted(r["tokens"])), r["label"].removeprefix(LABEL), r["confidence"], r["support"]) for r in rules.where(F.col("confidence") >= min_confidence).collect()]
    else:
        base = labelled.select(places.alias("places"), F.col("label").cast("string").alias("label"))
        if judged is not None:
            base = base.union(judged.select(places.alias("places"), F.lit(None).cast("string").alias("label")))
        base = materialize(base.where(F.size("places") > 0).groupBy("places", "label").agg(F.count(F.lit(1)).alias("n")), "url-items")
        leveled = _by_levels(base, len(ranked), n, min_support, min_confidence, judged is not None)
        found = [(tuple(sorted(ranked[i][0] for i in own)), label, (right + 1) / (fits + 2), right / n) for own, label, right, fits in leveled]
        drop_table(base)
    kept: dict[tuple[str, ...], list[MinedRule]] = defaultdict(list)
    out = []
    for own, label, confidence, support in sorted(found, key=lambda r: (len(r[0]), r[0], r[1])):
        shorter = (k for size in range(1, len(own)) for part in combinations(own, size) for k in kept.get(part, ()))
        if not any(k.label == label and k.confidence >= confidence for k in shorter):
            kept[own].append(MinedRule(own, label, confidence, support))
            out.append(kept[own][-1])
    return out


class RuleIndex:
    """Inverted index: each rule stands under its token that the fewest rules use."""

    def __init__(self, rules: list[MinedRule]) -> None:
        uses: dict[str, int] = defaultdict(int)
        for r in rules:
            for t in r.tokens:
                uses[t] += 1
        self.by_token: dict[str, list[MinedRule]] = defaultdict(list)
        for r in rules:
            self.by_token[min(r.tokens, key=lambda t: (uses[t], t))].append(r)

    def best(self, items: set[str]) -> MinedRule | None:
        """The matching rule of the highest confidence, then support, then the most and first tokens."""
        fits = [r for t in items for r in self.by_token.get(t, ()) if items.issuperset(r.tokens)]
        return min(fits, key=lambda r: (-r.confidence, -r.support, -len(r.tokens), r.tokens, r.label), default=None)


def url_filter(pages: DataFrame, rules: list[ListRule], id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, default: str = "allow", min_support: float = 0.005, min_confidence: float = 0.9) -> DataFrame:
    """Id, host, path, rule, verdict, mined (the tokens of the mined rule that decided, else null).

    ``labelled`` has ``url`` and ``label`` (allow or block); without it the URLs on which a listed rule decides are the
    labelled ones.
    """
    ready(pages)

    def prepared(df: DataFrame) -> DataFrame:
        host, path = split_url(F.col("url"))
        out = df.select("*", host.alias("host"), path.alias("path"))
        return out.select("*", listed(rules, F.col("host"), F.col("path")).alias("hit"), tokens(blank(F.col("url")), F.col("host"), F.col("path")).alias("items"))

    df = prepared(pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")))
    if labelled is None:
        hidden = F.array(*[F.lit(t) for t in named_tokens(rules)]).cast("array<string>")
        train = df.where("hit is not null").select(F.array_except("items", hidden).alias("items"), F.col("hit.verdict").alias("label"))
    else:
        train = prepared(labelled.select("url", "label")).select("items", "label").where("label is not null")
    index = RuleIndex(mine(train, min_support, min_confidence, judged=df.where("hit is null").select("items")))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, host, path, rule, verdict, items = batch.columns
            said, mined = verdict.to_pylist(), [None] * batch.num_rows
            for row, known in enumerate(said):
                if known is None:
                    best = index.best(set(items[row].as_py()))
                    said[row] = best.label if best else default
                    mined[row] = " ".join(best.tokens) if best else None
            yield pa.RecordBatch.from_arrays([ids, host, path, rule, pa.array(said, pa.string()), pa.array(mined, pa.string())], names=[id_col, "host", "path", "rule", "verdict", "mined"])

    return df.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"), "items").mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, mined string")
