"""The algorithms without Spark, against brute force."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tuplewave.llm import decontaminate as D
from tuplewave.llm import near_duplicates as N
from tuplewave.llm import packing, simhash, toxicity, warc
from tuplewave.llm.quality_lm import SYMBOLS, Lookup, _Seen, grams, own_codes, symbols
from tuplewave.llm.run_index import RunIndex
from tuplewave.llm.substring_dedup import ANCHOR, COVER, PERIOD, WINDOW, Words, is_cover
from tuplewave.llm.suffix_dedup import gram_sizes, pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=8), st.integers(2, 6))
def test_run_index(texts, length):
    data = [t.encode() for t in texts]
    counts = {}
    for d in data:
        for i in range(len(d) - length + 1):
            counts[d[i : i + length]] = counts.get(d[i : i + length], 0) + 1
    index = RunIndex(data)
    got = index.repeated(length)
    assert index.strings() == data  # the runs alone hold the texts
    assert all(len(x) == index.runs for x in (index.symbols, index.heads, index.tails, index.bounds))
    for d, ranges in zip(data, got, strict=True):
        wanted = [i for i in range(len(d) - length + 1) if counts[d[i : i + length]] > 1]
        assert [i for a, b in ranges for i in range(a, b)] == wanted


@pytest.mark.parametrize("gram", gram_sizes(200))
def test_pieces_cover_each_string_once(gram):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 199, 200, 500, 3000)] + [b"a" * 700]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    text, start, n, hashes = pieces(np.frombuffer(b"".join(texts), np.uint8), offsets, 200, gram)
    seen = sorted((int(t), int(s - offsets[t]) + k) for t, s, m in zip(text, start, n, strict=True) for k in range(m))
    assert seen == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 199)]
    by_string = {}
    for t, s, m, h in zip(text, start - offsets[text], n, hashes, strict=True):
        for k in range(m):
            assert by_string.setdefault(texts[t][s + k : s + k + 200], h) == h


def test_cover():
    assert is_cover(COVER, PERIOD)
    assert ANCHOR + PERIOD - 1 == WINDOW
    w = Words(np.frombuffer("a bç\n dd  ".encode() + b"x", np.uint8), np.array([0, 11, 12]))
    assert w.counts.tolist() == [3, 1]


def thue_morse(n, letters="ab"):
    """A word and its complement, whose polynomial hashes modulo 2**64 are equal from 1024 letters on."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_word_hashes():
    one, other = thue_morse(1024), thue_morse(1024, "ba")
    words = [one, other, "a", "aa", "b", "\0", "\0\0", "x" * 8, "x" * 9, "x" * 17, "é", "y" * 100_000]
    data = " ".join(words).encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(set(w.hashes.tolist())) == len(set(w.others.tolist())) == len(words) == len(w.begins)
    assert not set(w.hashes.tolist()) & set(w.others.tolist())
    empty = Words(np.zeros(0, np.uint8), np.array([0]))
    assert len(empty.hashes) == len(empty.others) == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    bins, wanted = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(50 - n)
    got = packing.sequences_of(lengths, 50)
    wanted = len(bins)
    assert len({s for s, _ in got}) == wanted
    for seq in {s for s, _ in got}:
        rows = sorted((o, n) for (s, o), n in zip(got, lengths, strict=True) if s == seq)
        assert all(o == sum(n for _, n in rows[:i]) for i, (o, _) in enumerate(rows))
        assert sum(n for _, n in rows) <= 50


def test_pieces_of_a_document():
    assert packing._pieces(1, 4) == [(0, 1)]
    assert packing._pieces(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing._pieces(8, 4) == [(0, 4), (4, 4)]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    encode, exact = packing.Encoder(path, packing.merges_by_id(path)), packing.Encoder(path, False)
    assert encode.fast and not exact.fast
    run = " \n" * packing.SPACES
    for text in ["", "Hello  world's\n\n  42 naïve 漢字 😀!", "a\u00a0b \t\n x", "<|endoftext|> ok", "don't we'LL", f"a{run}b  c{run}", "x" * 5000]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert exact(text) == encode(text)


def test_other_vocabularies_take_the_slow_way(tmp_path):
    """A file whose merges do not ascend by id, or whose texts are split otherwise, is left to its own library."""
    import json

    with open(packing.tokenizer_path(), encoding="utf-8") as file:
        whole = json.load(file)
    vocabulary, merges = whole["model"]["vocab"], whole["model"]["merges"]
    one, two = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges[:2])
    vocabulary[one], vocabulary[two] = vocabulary[two], vocabulary[one]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(whole), encoding="utf-8")
    assert not packing.merges_by_id(str(path))
    text = "the and ing in their heirs"
    from tokenizers import Tokenizer

    wanted = Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(str(path), False)(text), "<u4").tolist() == wanted


@pytest.mark.parametrize("zip64", [True, False])
def test_archive(zip64):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, zip64)
    writer.add(warc.record(1, "http://a/ü", b"<p>x</p>", "response"), "k")
    writer.add(warc.record(2, None, b"<p>x</p>", "revisit", 1), "k")
    writer.close()
    data = out.getvalue()
    reader = warc.ZipReader(io.BytesIO(data), len(data))
    assert set(reader.members) == {warc.DATA, warc.INDEX, warc.PACKAGE}
    (first, block), (second, head) = warc.records(reader)
    assert block.endswith(b"<p>x</p>") and first["warc-record-id"] == "<urn:page:1>"
    assert second["warc-refers-to"] == "<urn:page:1>" and b"Content-Length: 8" in head and b"<p>" not in head
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
    with pytest.raises(ValueError):
        warc.ZipReader(io.BytesIO(b"x" * 50), 50)


def test_foreign_archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment PK\x05\x06 inside"
        for i in range(3):
            z.writestr(f"m{i}", bytes([65 + i]) * 9)
    reader = warc.ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert reader.stored("m2") == b"C" * 9


def foreign(data, index, names, pack=True):
    """An archive as others write it: own names, no block digests, an index of another form."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr(names[0], data)
        if index is not None:
            z.writestr(names[1], index)
    return warc.ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))


def foreign_record(i, body):
    head = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://a/{i}\r\nContent-Type: application/http;\r\n  msgtype=response\r\nContent-Length: {len(head + body)}\r\n\r\n".encode() + head + body + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["cdxj", "cdxj.gz", "cdx", "none", "plain", "plain-none"])
def test_archives_of_other_writers(form, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "PART", 64)
    bodies = [b"<p>one</p>", b"", bytes(range(256)) * 9]
    records = [foreign_record(i, b) for i, b in enumerate(bodies)]
    packed = [r if form.startswith("plain") else gzip.compress(r) for r in records]
    at = [sum(map(len, packed[:i])) for i in range(3)]
    if form == "cdx":
        index = " CDX N b a V S g\n" + "".join(f"a,{i} 2020 http://a/{i} {at[i]} {len(packed[i])} rec-1.warc.gz\n" for i in range(3))
    else:
        index = '!meta {"format": "cdxj"}\n' + "".join(f'a)/{i} 2020 {{"url": "http://a/{i}", "offset": "{at[i]}", "length": {len(packed[i])}}}\n' for i in range(3))
    index = None if form.endswith("none") else gzip.compress(index.encode()) if form.endswith("gz") else index.encode()
    names = ("archive/rec-1.warc" + ".gz" * (not form.startswith("plain")), "indexes/all." + ("cdxj" if form.startswith("plain") else form))
    got = list(warc.records(foreign(b"".join(packed), index, names)))
    assert [f["warc-record-id"] for f, _ in got] == [f"<urn:uuid:{i}>" for i in range(3)]
    assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == bodies
    assert got[0][0]["content-type"] == "application/http; msgtype=response"
    with pytest.raises(ValueError):
        list(warc.records(foreign(b"".join(packed)[:-9], None, names)))


def test_segments():
    rng = random.Random(1)
    for distance, blocks in ((2, 2), (2, 3), (3, 3), (3, 4), (1, 1), (1, 2)):
        masks = simhash.segments(distance, blocks)
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), distance))
            assert any((m & flip).bit_count() <= 1 for m in masks)
    assert simhash.simhash_text(None) == simhash.simhash_text(" \n") == 0
    assert simhash.simhash_text("A b  C") == simhash.simhash_text("a b c")


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 90))) for _ in range(2))
        wanted = min(plain(a, b[: len(a) + 90]))
        got = D.edit_distance_prefix(a, b, 90)
        assert got is not None and got[0] == wanted


def bench_of(texts):
    return D.Items(list(range(len(texts))), texts, D.EDITS, D.repetitions_for(texts))


def invented(seed, sizes, low=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(low, 9))) for _ in range(3000)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    return prose, [prose(k) for k in sizes]


@pytest.mark.parametrize("share", [0.01, 0.03, 0.05, 0.08, 0.1])
def test_recall_of_edited_passages(share):
    """Edits of letters spread over the item; what is to be found comes from brute-force edit distances of all windows."""
    rng = np.random.default_rng(int(1000 * share))
    prose, texts = invented(5, [int(k) for k in rng.integers(8, 60, 80)])
    bench = bench_of(texts)
    assert 8 <= bench.repetitions <= D.MOST
    docs = [f"{prose(40)} {D.edited(t, int(len(t) * share), rng)} {prose(40)}" for t in texts]
    wanted = set()
    for d, doc in enumerate(docs):
        t, most = texts[d], bench.most(len(texts[d]))
        begins = [0] + [k + 1 for k, c in enumerate(doc) if c == " "]
        if any(D.edit_distance_prefix(t, doc[k : k + len(t) + most], most) for k in begins):
            wanted.add((d, d))
    found = {f[:2] for f in bench.search([None, *docs])}
    assert all(d - 1 == i for d, i in found)
    assert len(wanted) >= 70
    assert len({(d - 1, i) for d, i in found} & wanted) >= 0.95 * len(wanted)
    assert bench.search([]) == bench.search([None, ""]) == []


def test_repetitions_come_from_the_wanted_recall():
    _, texts = invented(6, range(20, 60))
    few, many = D.repetitions_for(texts, recall=0.3), D.repetitions_for(texts, recall=0.98)
    assert few < many
    assert D.repetitions_for([]) == D.repetitions_for(["ab"]) == D.FIRST


def test_short_items_at_the_limit():
    """Items below the bound are looked for by their pieces; ties, very long and repeated texts are searched like others."""
    prose, texts = invented(8, (2, 3, 4, 5, 6))
    bench = bench_of(texts)
    rng = np.random.default_rng(1)
    docs = [f"{prose(40)} {D.edited(t, bench.most(len(t)), rng)} {prose(40)}" for t in texts]
    found = {f[:2] for f in bench.search([*docs, *docs])}
    assert len({(i, i) for i in range(5)} & found) >= 4
    assert {(d + 5, i) for d, i in found if d < 5} == {f for f in found if f[0] >= 5}
    long = " ".join([prose(30_000), texts[4], prose(30_000)])
    assert (0, 4, 30_000, 6, 0) in bench.search([long])
    very = prose(3000)
    assert bench_of([very]).search([f"{prose(5)} {very} {prose(5)}"]) == [(0, 0, 5, 3000, 0)]


def test_exact_copies_of_short_items():
    """Inside longer texts, for items of all sizes from one word on; each repetition proposes each of them."""
    prose, texts = invented(9, range(1, 26), 3)
    bench = bench_of(texts)
    docs = [f"{prose(30)} {t} {prose(30)}" for t in texts]
    found = {f[:2]: f[2:] for f in bench.search(docs)}
    assert all(found[i, i] == (30, i + 1, 0) for i in range(25))
    windows = [d[d.index(t) :][: len(t)] for d, t in zip(docs, texts, strict=True)]
    for r in range(20):
        assert D.agree(texts, windows, range(r, r + 1)).all()
    twice = "ab cd ab cd"
    assert bench_of([twice]).search([f"x {twice} {twice} y"]) == [(0, 0, 1, 4, 0), (0, 0, 5, 4, 0)]


def test_kernel():
    k = toxicity.kernel([b"idiot"], [b"idiot", b"idxiot", b"table", b"i"])
    assert abs(k[0, 0] - 1) < 1e-5
    assert k[0, 1] > 0.5 > k[0, 2]
    assert toxicity.words_of("You I.D.I.O.T and s t u p i d!") >= {b"idiot", b"stupid", b"you"}
    assert toxicity.words_of(None) == set()


def labelled(n, seed):
    """Documents of a few sentences; toxic ones have insults, some with letters inserted, dots between or spaces."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 9))) for _ in range(1500)]
    insults = ["idiot", "stupid", "moron", "pathetic", "scum"]
    rows = []
    for i in range(n):
        sentences = [rng.choices(vocabulary, k=rng.randint(5, 14)) for _ in range(rng.randint(2, 6))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                w = rng.choice(insults)
                at = rng.randint(1, len(w) - 1)
                w = rng.choice([w, w, w, w[:at] + rng.choice("aeiox") + w[at:], ".".join(w), " ".join(w), w.upper() + "!"])
                own = rng.choice(sentences)
                own.insert(rng.randint(0, len(own)), w)
        rows.append((". ".join(" ".join(s) for s in sentences) + ".", int(i % 4 == 0)))
    return rows


def test_toxicity_of_held_out_documents():
    """Trained on some documents, measured on others: area under the curve and recall at the threshold."""
    train, test = labelled(1200, 1), labelled(600, 2)
    y = np.array([t for _, t in train])
    scorer = toxicity.fit_sentences([toxicity.sentences_of(t) for t, _ in train], y)
    worst = lambda rows: np.array([max(scorer.decide(list(set().union(*toxicity.sentences_of(t))))) for t, _ in rows])
    toxicity.calibrate(scorer, worst(train), y.astype(float))
    p, y = scorer.probability(worst(test)), np.array([t for _, t in test])
    auc = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert auc >= 0.94 and (p[y == 1] >= 0.7).mean() >= 0.93 and (p[y == 0] >= 0.7).mean() <= 0.05
    assert toxicity.fit_sentences([], np.zeros(0)) is None
    assert toxicity.fit_sentences([[{b"same"}], [{b"same"}]], np.array([0, 1])) is None


def test_long_words_are_scored_whole():
    rng = np.random.default_rng(1)
    scorer = toxicity.Scorer(rng.normal(size=toxicity.FEATURES), 0.3)
    for n in (1, 2, 3, 50, 3000):
        word = bytes(rng.integers(97, 123, n).astype(np.uint8))
        assert abs(scorer.long(word) - scorer.decide([word])[0]) < 1e-9
    long = bytes(rng.integers(97, 123, 200_000).astype(np.uint8))
    assert scorer.decide([b"ab", long]).tolist() == [scorer.decide([b"ab"])[0], scorer.long(long)]
    assert toxicity.sentences_of("a. b" + "c" * 9000)[1] == {b"b" + b"c" * 9000}


def test_language_model_codes():
    texts = ["", "ab", "Xy\t1", "漢é"]
    codes, begins, lengths = grams(texts)
    assert len(own_codes(texts)) == sum(map(len, texts)) == 8
    assert lengths.tolist() == [0, 2, 4, 2] and begins.tolist() == [0, 4, 10, 18]
    assert int(codes[begins[1]]) == 32 * (1 + SYMBOLS + SYMBOLS**2 + SYMBOLS**3) * SYMBOLS + ord("a")
    assert symbols("a\n漢")[:2].tolist() == [97, 32] and 3072 <= symbols("漢")[0] < SYMBOLS


def test_lookup_of_codes():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    known = Lookup(keys, np.arange(len(keys)) * 0.5)
    at = rng.integers(0, len(keys), 20_000)
    assert (known.get(keys[at]) == at * 0.5).all() and len(known.get(keys[:0])) == 0
    with pytest.raises(RuntimeError):
        known.get(keys[:1] + np.uint64(1))
    seen = _Seen()
    assert set(np.concatenate([seen.new(keys[a : a + 999]) for a in range(0, 5000, 500)]).tolist()) == set(keys.tolist())


@pytest.mark.parametrize(("n", "bits"), [(1, 1), (40, 6), (400, 9), (400, 33)])
def test_forest(n, bits):
    """Both searches link just what all pairs link, with a link less than values in each group."""
    mask = simhash.segments(3, 4)[0]
    wild = next(b for b in range(simhash.BITS) if mask >> b & 1)
    free = np.array([b for b in range(simhash.BITS) if not mask >> b & 1 or b == wild])
    rng = np.random.default_rng(n + bits)
    values = np.unique(np.array([sum(1 << int(b) for b in rng.choice(free[:bits], min(bits, int(rng.integers(0, 6))), replace=False)) for _ in range(n)], np.uint64))

    def groups(links):
        of = {i: {i} for i in range(len(values))}
        for i, j in links:
            if of[i] is not of[j]:
                of[i] |= of[j]
                of.update(dict.fromkeys(of[i], of[i]))
        return {frozenset(g) for g in of.values()}

    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= 3]
    want = groups(pairs)
    for links in (simhash._forest(values, mask, wild, 3), simhash._forest_by_lookup(values, simhash._flips(free, 3))):
        assert groups(links) == want
        assert len(links) == len(values) - len(want)
        assert all((int(values[i]) ^ int(values[j])).bit_count() <= 3 for i, j in links)


def test_forest_of_long_fingerprints():
    """Edited copies of one text hang on it, and groups without relation stay apart."""
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 256, (3, N.BITS // 8), dtype=np.uint8)
    flip = lambda row, k: row ^ np.packbits(np.isin(np.arange(N.BITS), rng.choice(N.BITS, k, replace=False)))
    prints = np.array([flip(bases[g], int(rng.integers(0, 16)) * (i > 0)) for g in range(3) for i in range(50)]).view(np.uint64)
    links = N.forest(prints)
    assert len(links) == 3 * 49 and all(i // 50 == j // 50 for i, j in links)
    assert N.forest(prints[:1]) == []
    keys = N.variants(prints.view(np.uint8)).reshape(len(prints), -1)
    assert keys.shape[1] == N.BITS
    for a, b in rng.integers(0, 150, (200, 2)):
        parts = np.bitwise_count(prints[a].view(np.uint32) ^ prints[b].view(np.uint32))
        assert bool(set(keys[a]) & set(keys[b])) == bool((parts <= 1).any())


def test_signatures():
    known = {}
    assert N.signature([], known) == bytes(32)
    assert N.signature(N.words_of("B a b"), known) == N.signature(N.words_of("a  b A"), known) != N.signature([b"a"], known)
    assert N.similarity_of(N.shingles([b"a", b"b"], 5), N.shingles([b"a", b"b"], 5)) == 1.0
    a, b = ([b"%d" % i for i in range(n)] for n in (10, 11))
    assert N.similarity_of(N.shingles(a, 5), N.shingles(b, 5)) == 6 / 7
    assert N.similarity_of(np.zeros(0, np.uint64), np.zeros(0, np.uint64)) == 1.0
