"""The operators on small tables with nulls, empty, long and repeated rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tuplewave.llm import quality_lm, suffix_dedup
from tuplewave.llm.decontaminate import leaks
from tuplewave.llm.near_duplicates import near_duplicates
from tuplewave.llm.packing import pack
from tuplewave.llm.quality_rules import quality_rules
from tuplewave.llm.queries import URL_RULES
from tuplewave.llm.simhash import simhash_components, simhash_text
from tuplewave.llm.substring_dedup import substring_dedup
from tuplewave.llm.toxicity import toxicity
from tuplewave.llm.url_filter import url_filter
from tuplewave.llm.warc import digest, round_trip

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("abcdefghijklm", k=RNG.randint(1, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, words string, spans long"


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


PASSAGE = prose(70)
BASE = prose(300)
TEXTS = [
    None, "", " \n\t ", "one", BASE, BASE, BASE.replace(" ", "  ", 5), prose(120) + "\n" + PASSAGE + " " + prose(90), PASSAGE + " " + prose(30), prose(45) + " é " + PASSAGE,
    " ".join(BASE.split()[:150] + ["changed"] + BASE.split()[151:]), "spam spam " * 200, "x" * 5000, prose(20) + "\n" + "same line here\n" * 6, prose(2500),
]
ROWS = [(i, t, "en" if i % 3 else None, "w", i) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(docs):
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, text, *_ in ROWS:
        w = words_of(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(repeated), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert got[4]["kept"] and not got[12]["kept"]


def test_broadcasts_are_checked_by_bytes(spark):
    from tuplewave.llm.common import broadcast_if_small

    hinted = lambda df, limit: "ResolvedHint" in broadcast_if_small(df, limit)._jdf.queryExecution().analyzed().toString()
    rows = spark.createDataFrame([(1, "x" * 500, [1, 2]), (None, None, None)], "a long, b string, c array<int>")
    assert hinted(rows, 700) and not hinted(rows, 400)
    assert hinted(rows.limit(0), 0)


def check_suffix_dedup(df, rows, length, **options):
    data = {i: (t or "").encode() for i, t in rows}
    counts = Counter(d[k : k + length] for d in data.values() for k in range(len(d) - length + 1))
    found, x = suffix_dedup.suffix_dedup(df, length=length, **options)
    got = found.select("doc_id", x).collect()
    assert len(got) == len(rows)
    for r in got:
        d, s = data[r["doc_id"]], r[x]
        cut = {k + j for k in range(len(d) - length + 1) if counts[d[k : k + length]] > 1 for j in range(length)}
        kept = bytes(b for k, b in enumerate(d) if k not in cut)
        assert (s["n_bytes"], s["n_removed"], s["kept"], s["kept_sha256"]) == (len(d), len(cut), kept, hashlib.sha256(kept).hexdigest())
        assert {k for q in s["spans"] for k in range(q["a"], q["b"])} == cut


@pytest.mark.parametrize("crowded", [1 << 18, 1])
def test_suffix_dedup(docs, crowded):
    check_suffix_dedup(docs, [r[:2] for r in ROWS], 80, shard_bytes=4000, crowded_bytes=crowded)


def test_suffix_dedup_crowded_minimizer(spark):
    """One passage of 70 bytes in 4500 different surroundings, some of which repeat: its minimizer is divided."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = letters(70)
    rows = [(i, letters(30) + passage + letters(30)) for i in range(4500)]
    rows += [(5000 + i, rows[i][1][15 + i :]) for i in range(12)] + [(6000, rows[3][1]), (6001, None)]
    check_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 80, crowded_bytes=20_000)


def test_substring_dedup(docs):
    words = {i: words_of(t) for i, t, *_ in ROWS}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    found, x = substring_dedup(docs, joined=True)
    plain = {r["doc_id"]: r[y]["kept_text"] for f, y in [substring_dedup(docs)] for r in f.collect()}
    for r in found.collect():
        w = words[r["doc_id"]]
        cut = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r["doc_id"] for j in range(50)}
        kept = [a for k, a in enumerate(w) if k not in cut]
        assert (r[x]["n_words"], r[x]["n_removed"], r[x]["kept_text"]) == (len(w), len(cut), " ".join(kept))
        assert words_of(plain[r["doc_id"]]) == kept


def test_long_words_that_polynomials_confuse(spark):
    """49 equal words and a 50th of 1024 letters that differ: no window repeats."""
    start = " ".join(f"w{i}" for i in range(49))
    last = ["".join(letters[i.bit_count() & 1] for i in range(1024)) for letters in ("ab", "ba")]
    df = spark.createDataFrame([(1, f"{start} {last[0]}"), (2, f"{start} {last[1]}"), (3, f"{start} {last[0]}")], "doc_id long, text string")
    found, x = substring_dedup(df)
    assert sorted((r["doc_id"], r[x]["n_removed"]) for r in found.collect()) == [(1, 0), (2, 0), (3, 50)]


def test_repeated_ids(spark):
    rows = [(1, BASE), (1, BASE), (None, BASE), (2, BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, x = substring_dedup(df)
    assert sorted((r["doc_id"] or 0, r[x]["n_removed"]) for r in found.collect()) == [(0, 0), (1, 0), (1, 0), (2, 300)]
    assert simhash_components(df).count() == 4


def test_simhash(docs):
    prints = {i: simhash_text(t) for i, t, *_ in ROWS}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in simhash_components(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == prints
    assert root[5] == 4 and root[1] == root[2] == 0


def test_simhash_large_key(spark):
    """Many fingerprints in one key: the neighbour search takes over from comparing pairs."""
    from tuplewave.llm.simhash import links

    values = [(i << 45) | 7 for i in range(3000)]
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    got = {(r["src"] % 2**64, r["dst"] % 2**64) for r in links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    near = {v: v for v in values}

    def find(v):
        while near[v] != v:
            v = near[v]
        return v

    for a, b in got:
        near[find(a)] = find(b)
    assert len({find(v) for v in values}) == 1


def classes_by_brute_force(rows, similarity=0.8, size=5):
    sets, root = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = words_of((t or "").lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size, 0) + 1)}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs):
    """Copies with words changed, added or left out, down to a similarity of 0.8, against all pairs."""
    rng = random.Random(12)
    rows = [(i, t) for i, t, *_ in ROWS]
    for g in range(25):
        base = prose(rng.randint(90, 400)).split()
        rows.append((1000 + 10 * g, " ".join(base)))
        for k in range(1, 6):
            w = base[:]
            for at in sorted(rng.sample(range(len(w)), max(1, round(len(w) * 0.011 * k / 2))), reverse=True):
                w[at : at + 1] = rng.choice([["new"], [w[at], "more"], []])
            rows.append((1000 + 10 * g + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df, "doc_id").collect()}
    wanted = classes_by_brute_force(rows)
    assert sum(got[i] == wanted[i] for i in wanted) >= 0.9 * len(wanted)
    assert all(wanted[got[i]] == wanted[i] for i in wanted)  # nothing is merged that is not alike
    assert near_duplicates(df.limit(0), "doc_id").count() == 0


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    """A group that is read in parts still is one class."""
    from tuplewave.llm import near_duplicates as N

    monkeypatch.setattr(N, "PART", 64)
    base = prose(300).split()
    rows = []
    for i in range(400):
        w = base[:]
        w[i % 300] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()
    assert {r["class_id"] for r in got} == {0} and len(got) == 400


@pytest.mark.parametrize("near", [56, 0])
def test_near_duplicates_are_all_pairs_that_meet_the_similarity(spark, near):
    """Links whose fingerprints are far apart, by few distinct words or by a search that reaches nothing, and chains of edits."""
    rng = random.Random(4)
    rows = [(i, t) for i, t, *_ in ROWS]
    for g in range(30):
        few = " ".join(rng.choice([f"a{g}", f"b{g}"]) for _ in range(60))
        rows += [(2000 + 2 * g, few), (2001 + 2 * g, few + f" c{g}")]
    for g in range(6):
        w = prose(rng.randint(60, 200)).split() + ["the", "same", "last", "line", "everywhere"]
        for k in range(8):
            rows.append((3000 + 10 * g + k, " ".join(w)))
            for _ in range(rng.randint(1, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"edit{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df, "doc_id", near=near).collect()}
    assert got == classes_by_brute_force(rows)


def test_near_duplicates_write_no_pairs_of_a_group(spark):
    """Links of many texts of different classes that are alike, and of others that share a passage only, grow in proportion."""
    from tuplewave.llm import near_duplicates as N

    def links(n):
        rng = random.Random(n)
        base, passage, rows = [f"word{i}" for i in range(150)], " ".join(f"rare{i}" for i in range(30)), []
        for i in range(n):
            w = base[:]
            w[rng.randrange(150)] = f"edit{i}"
            rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(f"own{i}x{k}" for k in range(90)) + " " + passage)]
        df = spark.createDataFrame(rows, "key long, text string")
        marked = N._signatures(df, "bigint").cache()
        texts = marked.select(F.col("key").alias("node"), "content", F.col("key").alias("least"))
        alone = spark.createDataFrame([], "node long, root long")
        return [(r["src"], r["dst"]) for r in N._left_out(df, marked, texts, alone, 5, 0.8).collect()], n

    few, many = (links(n) for n in (40, 160))
    for found, n in (few, many):
        reached = {0}
        for _ in range(n):
            reached |= {x for pair in found if reached & set(pair) for x in pair}
        assert reached == set(range(0, 2 * n, 2)) and all(x % 2 == 0 for pair in found for x in pair)
    assert len(many[0]) < 8 * len(few[0])


def test_packing(spark, docs):
    """Ids, checksums and places of every piece, and as many sequences as best fit takes piece by piece; repeated and null ids."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tuplewave.llm.packing import sequences_of, tokenizer_path

    encode = Tokenizer.from_file(tokenizer_path())
    encode.encode_special_tokens = True
    rows = [(i, t) for i, t, *_ in ROWS] + [(4, "again"), (None, "nobody"), (4, "again")]
    wanted, lengths = Counter(), []
    for i, t in rows:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 2048
        cuts = sorted({0, *range(head, len(ids), 2048), len(ids)})
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            wanted[i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
            lengths.append(b - a)
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == len({s for s, _ in sequences_of(lengths, 2048)}) <= sum(lengths) // 2048 + 2


def test_decontamination(spark, docs):
    items = [(1, PASSAGE.upper()), (2, None), (3, " ".join(BASE.split()[100:140])), (4, prose(30))]
    got = leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] == 1} == {(7, 1), (8, 1), (9, 1)}
    assert {r["doc_id"] for r in got if r["item_id"] == 3} >= {4, 5, 6, 10}
    assert {r["item_id"] for r in got} == {1, 3}
    assert next(r["distance"] for r in got if r["doc_id"] == 8) == 0
    assert len(leaks(docs, spark.createDataFrame(items, "item_id long, text string"), block_items=1).collect()) == len(got)


def plain_model(texts):
    """p of every n-gram by recursion over dictionaries, as a function."""
    order, tables = quality_lm.ORDER, {}
    coded = lambda t: tuple(quality_lm.symbols(" " * (order - 1) + t).tolist())
    top = Counter(c[i : i + order] for c in map(coded, texts) for i in range(len(c) - order + 1))
    for k in range(order, 0, -1):
        tables[k] = top if k == order else Counter(g[1:] for g in tables[k + 1])
    cuts = {k: quality_lm.discounts(*(sum(c == i for c in t.values()) for i in range(1, 5))) for k, t in tables.items()}

    def p(g):
        if not g:
            return 1 / quality_lm.SYMBOLS
        table, cut = tables[len(g)], cuts[len(g)]
        own = {x: c for x, c in table.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        d = lambda c: cut[min(c, 3) - 1]
        c = table.get(g, 0)
        return ((c - d(c) if c else 0) + sum(map(d, own.values())) * p(g[1:])) / sum(own.values())

    return lambda t: [p(coded(t)[i : i + order]) for i in range(len(t))]


def test_language_model_by_brute_force(spark):
    """Costs of whole texts, and probabilities of all symbols after a context, which sum to one."""
    import math

    texts = [prose(40), prose(25) + "\té漢", "aab aab aac"]
    model = quality_lm.Model(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"))
    p = plain_model(texts)
    rows = [(1, texts[0][:60]), (2, "unseen ZZ 漢字"), (3, ""), (4, " \n"), (5, "x"), (6, texts[2])]
    bits = quality_lm.SYMBOL_BITS
    for context in ("aab ", "ZZZZ"):
        h = 0
        for c in quality_lm.symbols(context).tolist():
            h = h << bits | c
        asked = spark.range(quality_lm.SYMBOLS).select((F.lit(h << bits) + F.col("id")).alias("g"))
        assert abs(model.probabilities(asked).agg(F.sum("p")).head()[0] - 1) < 1e-6
    got = {r["key"]: r for r in quality_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model, "doc_id").collect()}
    assert len(got) == 6
    for i, t in rows:
        wanted = -sum(map(math.log, p(t))) if t.strip() else 0.0
        assert abs(got[i]["nats"] - wanted) < 1e-6 * max(1, wanted) and got[i]["chars"] == len(t) * bool(t.strip())


def test_quality_classifier(spark, tmp_path):
    clean = [(i, prose(80), "aa", "w", i) for i in range(60)]
    junk = [(100 + i, "".join(RNG.choices("QZXWVK#|!0123456789", k=400)), "aa", "w", i) for i in range(3)]
    junk += [(200, None, None, "w", 0), (201, clean[0][1], None, "w", 0), (None, clean[1][1], "bb", "w", 0), (202, clean[2][1] * 200, "aa", "w", 0), (100, junk[0][1], "aa", "w", 0)]
    df = spark.createDataFrame(clean + junk, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in [*range(40), 3]] + [(None,)], "id long")
    found, x = quality_lm.classify(df, trusted, low=0, high=1)
    assert found.columns[:-1] == df.columns and found.count() == df.count()
    kept = {}
    for r in found.collect():
        kept.setdefault(r["doc_id"], []).append(r[x]["kept"])
    # What was seen in training or held out is kept; other clean text may be beyond the few that were held out.
    assert sum(all(kept[i]) for i in range(60)) >= 55 and kept[201] == [True] and len(kept[202]) == 1
    assert kept[100] == [False, False] and not any(kept[i][0] for i in (101, 102, 200))
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    again, y = quality_lm.classify(spark.read.parquet(f"{tmp_path}/docs"), trusted, low=0, high=1)
    values = lambda f, c: sorted((r["doc_id"] or -1, round(r[c]["perplexity"] or 0, 6), r[c]["kept"]) for r in f.collect())
    assert values(found, x) == values(again, y)
    nobody, z = quality_lm.classify(df, trusted.limit(0))
    assert {r["doc_id"] for r in nobody.collect() if not r[z]["kept"]} == {200}


def test_limits_are_quantiles_of_each_language(spark):
    rows = [("aa", 100.0 + i, 1000, True) for i in range(500)] + [("bb", 300.0 + i, 1000, True) for i in range(500)]
    rows += [(None, 1.0, 1000, True), ("aa", 0.0, 0, True), ("cc", 9.0, 1000, False), ("bb", 99_999.0, 1000, False)]
    got = {r["lang"]: r for r in quality_lm.limits_of(spark.createDataFrame(rows, "lang string, nats double, chars long, held_out boolean"), 0.1, 0.9).collect()}
    for lang, first in (("aa", 100.0), ("bb", 300.0)):
        mean = (first + 249.5) / 1000
        smooth = [(first + i + quality_lm.PRIOR_CHARS * mean) / (1000 + quality_lm.PRIOR_CHARS) for i in (50, 450)]
        assert abs(got[lang]["low"] - smooth[0]) < 0.002 and abs(got[lang]["high"] - smooth[1]) < 0.002
    assert set(got) == {"aa", "bb", ""}


def test_toxicity(spark):
    insults = ["stupid", "idiot", "moron", "loser"]
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        w = prose(60).split()
        if toxic:
            for a in RNG.sample(insults, 3):
                w.insert(RNG.randrange(60), a)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, "you are an i.d.i.o.t " + prose(20)), (901, prose(50)), (902, None), (903, "")]
    labels += [(None, 1), (901, None)]
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    said = {r["doc_id"]: r["predicted"] for r in got}
    right = sum(said[i] == y for i, y in labels if i is not None and y is not None)
    assert right >= 152 and said[900] == 1 and said[902] == said[903] == 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_warc(spark):
    pages = [(3, "http://a/b c", "x<p>ü"), (1, None, "x<p>ü"), (2, "u", None), (5, "u", ""), (4, "u", "y" * 100_000), (None, "u", "y" * 100_000), (1, "v", "other")]
    got = round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    wanted = Counter((p, len((h or "").encode()), digest((h or "").encode())) for p, _, h in pages)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == wanted
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(3, 1), (5, 2)}


def test_warc_of_other_writers(spark, tmp_path):
    """A directory of archives that this package has not written, read as a table; clashing columns of pages are ignored."""
    import gzip
    import zipfile

    from tuplewave.llm.warc import read_archives

    body = "<p>é</p>".encode()
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:7>\r\nWARC-Target-URI: http://a/\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(head + body) + head + body + b"\r\n\r\n"
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/rec-1.warc.gz", gzip.compress(record))
    got = read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")).collect()
    assert [(r["record"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], bytes(r["payload"])) for r in got] == [("<urn:uuid:7>", "http://a/", len(body), digest(body), "response", body)]
    pages = spark.createDataFrame([(1, "u", "x", "k", "f"), (2, "u", "x", "k", "f")], "page_id long, url string, html string, key string, first string")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in round_trip(pages).collect()) == [(1, "response", None), (2, "revisit", 1)]


def test_url_filter(spark):
    urls = ["https://www.example.com/en/x", "http://a.example.com/en/?q", "http://shop.com/x", "http://b.net/fr/1", "http://B.NET/de/1", "no scheme", None, "x://h.org?y", "http://com/"]
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["www.example.com/en/", "example.com/en/", "com/", "net/fr/", None, None, None, None, "com/"]
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "allow", "block"]
    assert (got[4]["host"], got[4]["path"], got[7]["host"], got[7]["path"], got[5]["host"]) == ("b.net", "/de/1", "h.org", "", "")
    many = [(f"http://{'spam' if i % 2 else 'good'}.site{i % 7}.org/p/{i}", "block" if i % 2 else "allow") for i in range(400)]
    labelled = spark.createDataFrame(many, "url string, label string")
    told = url_filter(spark.createDataFrame([(1, "http://spam.new.org/z"), (2, "http://good.new.org/z")], "page_id long, url string"), [], labelled=labelled).collect()
    assert {r["page_id"]: r["verdict"] for r in told} == {1: "block", 2: "allow"}


def test_url_filter_by_brute_force(spark):
    """Mined rules equal those from all subsets of the URLs' tokens; nulls, repeated rows, ties and clashing columns."""
    from tuplewave.llm import url_filter as U

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "spam", "win"]
    rows = []
    for _ in range(300):
        own = rng.sample(words, rng.randint(1, 4))
        bad = "spam" in own or {"alpha", "win"} <= set(own)
        rows.append(("http://h.org/" + "/".join(own), "block" if bad != (rng.random() < 0.02) else "allow"))
    rows += [rows[0], (None, "block"), ("http://h.org/alpha", None)]
    labelled = spark.createDataFrame(rows, "url string, label string")
    host, path = U.split_url(F.col("url"))
    items = labelled.where("label is not null").select("label", U.tokens(F.coalesce("url", F.lit("")), host, path).alias("items")).cache()
    plain = [(set(r["items"]), r["label"]) for r in items.collect()]
    got = {(r.tokens, r.label): r.confidence for r in U.mine(items, 0.02)}
    wanted = {}
    tokens = sorted(set().union(*(t for t, _ in plain)) - {"scheme:http", "host:h", "host:org"} | {"host:h"})
    from itertools import combinations

    for size in range(1, 7):
        for own in combinations(tokens, size):
            fit = [y for t, y in plain if t >= set(own)]
            for label in ("allow", "block"):
                right = sum(y == label for y in fit)
                value = (right + 1) / (len(fit) + 2)
                if right >= 0.02 * len(plain) and value >= 0.9 and not any(k[1] == label and set(k[0]) <= set(own) and v >= value for k, v in wanted.items()):
                    wanted[own, label] = value
    assert got == wanted and len(wanted) >= 2
    pages = spark.createDataFrame([(1, "http://x.net/spam", "a", "b"), (1, "http://x.net/spam", "a", "b"), (None, None, "a", "b"), (2, "http://x.net/beta", None, None)], "page_id long, url string, verdict string, items string")
    said = url_filter(pages, [], labelled=labelled).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in said) == [(0, "allow"), (1, "block"), (1, "block"), (2, "allow")]
    assert {r["verdict"] for r in url_filter(pages, [], labelled=labelled.limit(0), default="block").collect()} == {"block"}
    assert url_filter(pages.limit(0), URL_RULES).count() == 0


def test_url_filter_with_many_query_keys(spark):
    """Thirty keys that come and go together, and thirty that come and go on their own: mining stays bounded."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        keys = [f"k{k}" for k in range(30)] if i % 3 else []
        keys += [f"r{k}" for k in range(30) if rng.random() < 0.9] + ["bad"] * (i % 2)
        rows.append((f"http://site{i % 5}.org/x?" + "&".join(f"{k}={i}" for k in keys), "block" if i % 2 else "allow"))
    labelled = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([(1, "http://new.org/?bad=1"), (2, "http://new.org/?good=1")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter(pages, [], labelled=labelled).collect()} == {1: "block", 2: "allow"}


def test_url_filter_learns_from_all_items_of_long_urls(spark):
    """Two keys that tell nothing alone decide together, in URLs with many keys that tell a little; both ways of mining agree."""
    from tuplewave.llm import url_filter as U

    rng = random.Random(8)
    rows = []
    for i in range(240):
        keys = [f"n{k}" for k in range(18) if rng.random() < 0.9] + ["p"] * (i % 2) + ["q"] * (i // 2 % 2)
        rows.append((f"http://h.org/?{'&'.join(f'{k}=1' for k in keys)}", "block" if i % 2 and i // 2 % 2 else "allow" if i % 2 or i // 2 % 2 else "block"))
    labelled = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([(1, "http://x.net/?p=1&q=1"), (2, "http://x.net/?p=1"), (3, "http://x.net/")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_filter(pages, [], labelled=labelled).collect()}
    assert got == {1: ("block", "key:p key:q"), 2: ("allow", None), 3: ("allow", None)}
    words = [f"w{i}" for i in range(6)]
    short = []
    for _ in range(300):
        own = rng.sample(words, rng.randint(1, 5))
        short.append((own, "block" if {"w0", "w1"} <= set(own) or ("w2" in own and rng.random() < 0.95) else "allow"))
    items = spark.createDataFrame(short, "items array<string>, label string").cache()
    want = set(U.mine(items, 0.01, 0.8))
    assert set(U.mine(items, 0.01, 0.8, most_items=0)) == want and max(len(r.tokens) for r in want) >= 2
    page = {"w0", "w1", "w3"}
    some = U.mine(items, 0.01, 0.8, most_items=0, judged=spark.createDataFrame([(sorted(page),)], "items array<string>"))
    assert set(some) == {r for r in want if page.issuperset(r.tokens)}


def test_url_filter_hides_what_the_list_names(spark):
    from tuplewave.llm import url_filter as U

    assert U.named_tokens(URL_RULES) == ["host:com", "host:example", "host:net", "host:www", "path:en", "path:es", "path:fr"]
    urls = [f"http://shop{i}.net/es/deal" for i in range(30)] + [f"http://shop{i}.com/news" for i in range(30)]
    urls += ["http://other.org/deal", "http://other.org/news", "http://other.org/es/"]
    got = url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    assert {r["page_id"]: (r["verdict"], r["mined"]) for r in got if r["page_id"] >= 60} == {60: ("block", "path:deal"), 61: ("allow", "path:news"), 62: ("allow", None)}


def test_quality_rules_with_repeats_and_clashes(spark):
    """Repeated rows and null ids are judged one by one; columns named like measured ones are not used; ties change no verdict."""
    from tuplewave.llm.quality_rules import Rule

    rows = [(1, BASE, 9, True), (1, BASE, 9, True), (None, "x", 9, False), (2, None, None, None), (3, "# " * 400, 0, True), (4, prose(100_000), 1, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality_rules(df).collect()))
    assert got == sorted([(1, 300, True), (1, 300, True), (0, 1, False), (2, 0, False), (3, 400, False), (4, 100_000, got[-1][2])])
    same = [Rule("a", F.col("n_words") > 1000), Rule("b", F.col("n_words") > 1000)]
    assert {r["doc_id"]: r["kept"] for r in quality_rules(df.where("doc_id = 4 or doc_id = 1"), rules=same).collect()} == {1: True, 4: False}


def test_toxicity_with_repeats_and_clashes(spark):
    """Repeated rows get one score each and the same; labels that disagree count as toxic; very long words and texts pass."""
    rows = []
    for i in range(80):
        w = prose(40).split()
        if i % 4 == 0:
            w[i % 40 : i % 40] = ["idiot", "moron"]
        rows.append((i, " ".join(w), 0.5, "clash"))
    rows += [rows[0], rows[1], (500, "x" * 100_000, 0.1, "c"), (501, prose(30_000), 0.1, "c"), (None, "you idiot", None, None)]
    labels = [(i, int(i % 4 == 0)) for i in range(80)] + [(0, 0), (0, 1), (1, None)]
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["score"], r["predicted"]))
    assert len(by[0]) == 2 and len(set(by[0])) == len(set(by[1])) == 1
    assert by[None][0][1] == 1 and by[500][0][1] == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0).cache()
    assert quality_rules(none).count() == pack(none).count() == simhash_components(none).count() == 0
    assert suffix_dedup.suffix_dedup(none)[0].count() == substring_dedup(none)[0].count() == 0
    assert quality_lm.classify(none, none.select("doc_id"))[0].count() == 0
    assert toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(i, prose(150), "aa", "s", 1) for i in range(60)]
    rows += [(100, rows[3][1], "aa", "s", 1), (101, prose(60) + " " + PASSAGE, "aa", "s", 1), (102, rows[5][1] + " " + prose(150), "aa", "s", 1), (103, "#|!0QZ" * 80, "aa", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in docs.collect()})
    assert 103 not in left[0] and 100 in left[0]
    assert 100 not in left[1] and 3 in left[1]
    cut = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(words_of(cut[102])) == 150
    assert 101 not in left[3] and left[3] == set(range(60)) | {102}
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == left[3]


def test_pipeline_with_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Each stage takes null texts, languages and ids, repeated rows and ids, a clashing column, and tables without rows."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string"
    rows = [(i, prose(150), "aa", "s", 1, "k") for i in range(40)]
    rows += [(3, prose(150), "aa", "s", 1, "k"), (None, prose(150), None, None, None, None), (None, rows[4][1], "aa", "s", 1, None), (50, None, "aa", "s", 0, "k"), (51, "", None, "s", 0, "k"), rows[7]]
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name, labels, items in (("some", [(i, 1, 0) for i in range(40)] + [(None, 1, None)], [(1, PASSAGE), (None, None)]), ("none", [], [])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        sf = f"{tmp_path}/{name}"
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
            out = spark.read.parquet(f"{sf}/{k}")
            assert name == "some" or out.count() == 0
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns
                docs = out
        if name == "some":
            texts = [r["text"] for r in docs.collect()]
            assert None not in texts and "" not in texts and len(texts) == len(set(texts)) >= 35
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
