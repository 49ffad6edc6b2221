"""The deduplication operators and the pipeline against brute force."""

import os
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import common, components, ngram_join, repeats, substring, suffix
from keyloom.llm.words import U, windows, word_hashes


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("e", "rows", "n", "token")})


def brute_join(rows):
    sets = {}
    for k, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def brute_words(rows):
    seen, out = {}, {}
    for k, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            if seen.setdefault(x, k) < k:
                gone[i : i + 50] = [True] * 50
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def brute_bytes(rows):
    seen, out = set(), {}
    for k, t in sorted(rows):
        d = (t or "").encode()
        gone = bytearray(len(d))
        for i in range(len(d) - 99):
            if d[i : i + 100] in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(d[i : i + 100])
        out[k] = (len(d), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(c for c, g in zip(d, gone) if not g))
    return out


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [" ".join(random.choice(vocabulary) for _ in range(n)) for n in (55, 80, 200)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(random.randint(0, 4)):
            parts.append(" ".join(random.choice(vocabulary) for _ in range(random.randint(1, 60))))
            if random.random() < 0.5:
                parts.append(random.choice(passages)[random.randint(0, 30) :])
        out.append((i * 3 - 50, " ".join(parts)))
    base = [[random.choice(vocabulary) for _ in range(n)] for n in (3, 20, 60, 120)]
    for i in range(150):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        out.append((1000 + i, " ".join(w).upper() if i % 3 == 0 else "\n".join(w)))
    return out + [(5000, None), (5001, ""), (5002, "a" * 500), (5003, "ab" * 300), (5004, "ab" * 300), (5005, "abcdefg" * 100 + "x" + "abcdefg" * 60), (5006, "é" * 300), (5007, out[10][1]), (5008, "u v " * 60), (5009, "A  b"), (5010, "a b")]


def test_ngram_join(spark, rows):
    found = ngram_join.ngram_join(frame(spark, rows)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got == brute_join(rows)
    sets = dict(zip([k for k, _ in rows], (set(s.tolist()) for s in ngram_join.shingle_sets([t or "" for _, t in rows]))))
    links = {k: sum(100 * len(s & x) >= 80 * len(s | x) for j, x in sets.items() if j != k and s & x) for k, s in sets.items()}
    assert {r.doc_id: r.n_links for r in found} == links and max(links.values()) > 20
    assert ngram_join.ngram_join(frame(spark, rows), counted=False).columns == ["doc_id", "n_shingles", "component_id"]
    assert ngram_join.ngram_join(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("side", [512, 7])
def test_ngram_join_gives_every_link(spark, side, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE_SETS", side)
    random.seed(5)
    base = [[f"w{random.randrange(900)}" for _ in range(n)] for n in (40, 90, 200)]
    rows = []
    for i in range(120):  # near copies: many groups of 9 sets or more
        w = list(base[i % 3])
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            w[random.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w[: len(w) - random.randrange(8)])))
    sets = {k: ngram_join.set_id(s) for (k, _), s in zip(rows, ngram_join.shingle_sets([t for _, t in rows]))}
    of = dict(zip(sets.values(), ngram_join.shingle_sets([t for _, t in rows])))
    want = {(a, b) for a in of for b in of if a < b and 100 * (n := len(set(of[a].tolist()) & set(of[b].tolist()))) >= 80 * (len(of[a]) + len(of[b]) - n)}
    members, links = ngram_join.join_sets(frame(spark, rows))
    got = [(r.a, r.b) for r in links.collect()]
    assert len(want) > 3 * len(of) and len(got) == len(want) and set(got) == want
    assert {r.doc_id: r.e for r in members.collect()} == sets
    assert ngram_join.join_sets(frame(spark, rows).limit(0))[1].count() == 0


def test_ngram_join_of_rows_without_ids(spark):
    w = [f"w{i}" for i in range(100)]
    near = lambda *at: " ".join("x" if i in at else y for i, y in enumerate(w))
    # 1 and 2 link only through the row without an id; those of other words link with each other.
    rows = [(1, near(2, 10)), (None, near(10)), (2, near(10, 97, 50)), (None, "other " + near(*range(0, 100, 2))), (None, "words " + near(*range(0, 100, 2))), (None, None), (None, "")]
    a, b, c = (set(s.tolist()) for s in ngram_join.shingle_sets([rows[0][1], rows[1][1], rows[2][1]]))
    like = lambda x, y: len(x & y) / len(x | y)
    assert like(a, b) >= 0.8 and like(b, c) >= 0.8 > like(a, c)
    members, links = ngram_join.join_sets(frame(spark, rows))
    assert links.count() == 3
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0)] * 4 + [(0, 1), (1, 1), (2, 1)]


def test_substring_dedup(spark, rows):
    got = {r.doc_id: tuple(r)[1:] for r in substring.dedup_substrings(frame(spark, rows)).collect()}
    assert got == brute_words(rows)
    assert substring.dedup_substrings(frame(spark, rows).limit(0)).count() == 0


def test_spans_name_their_source(spark, rows):
    held = repeats.held_texts(frame(spark, rows), "doc_id", "text")
    texts = {r.row: (r.doc_id, (r.text or "").split()) for r in held.collect()}
    edges, spans = substring.repeated_edges(held).count(), substring.repeated_spans(held).collect()
    assert 0 < len(spans) < edges / 2
    for s in spans:
        (doc, mine), (source, words) = texts[s.row], texts[s.source_row]
        n = s.windows + substring.SIZE - 1
        assert source < doc and mine[s.start : s.start + n] == words[s.source_start : s.source_start + n]
        assert bytes(s.digest) == substring.digest([w.encode() for w in words], s.source_start, n)


@pytest.mark.parametrize("split, block", [(4096, 8192), (1, 3), (16, 1)])
def test_suffix_dedup(spark, rows, split, block, monkeypatch):
    monkeypatch.setattr(suffix, "SPLIT", split)
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(repeats, "TOGETHER", 16)
    out = suffix.dedup_suffixes(frame(spark, rows), carried=("n",)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == brute_bytes(rows)
    assert {r.n for r in out} == {"clash"}


def test_suffix_dedup_of_an_anchor_with_thousands_of_contents(spark):
    random.seed(21)
    passage = "".join(random.choice("abcdefghij ") for _ in range(120))
    rows = [(i, "".join(random.choice("klmnop") for _ in range(random.randrange(90))) + passage + "".join(random.choice("qrst") for _ in range(random.randrange(90)))) for i in range(5000)]
    out = suffix.dedup_suffixes(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == brute_bytes(rows)


def test_dedup_of_rows_that_share_an_id(spark):
    random.seed(22)
    words = lambda n: " ".join(f"v{random.randrange(10**6)}" for _ in range(n))
    p = words(60)
    for other in (words(5), words(300)):
        rows = [(1, p), (7, words(100) + " " + p), (7, other), (None, p), (None, p), (7, words(10) + " " + p)]
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.dedup_substrings(frame(spark, rows)).collect())
        assert got == sorted((k or 0, len(t.split()), 60 if k == 7 and p in t else 0) for k, t in rows)
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.dedup_suffixes(frame(spark, rows)).collect())
        want = [(k or 0, len(t), len(p) + 1 if k == 7 and p in t else 0, int(k == 7 and p in t)) for k, t in rows]
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and all(a[3] == b[3] and 0 <= a[2] - b[2] + 1 <= 3 for a, b in zip(got, sorted(want)))
        same = [(3, p), (3, p)]
        assert sorted(r.n_removed for r in suffix.dedup_suffixes(frame(spark, same)).collect()) == [0, len(p)]
        assert [r.n_removed for r in substring.dedup_substrings(frame(spark, same)).collect()] == [0, 0]


def test_deep_shallow_order():
    random.seed(12)
    text = bytes(random.choice(b"ab") for _ in range(2000)) + b"abc" * 150 + bytes(100)
    places = np.array([random.randrange(len(text) - 100) for _ in range(3000)])
    cut = [text[i : i + 100] for i in places]
    want = sorted(range(len(places)), key=lambda i: (cut[i], i))
    order, new = suffix.deep_shallow(text, places)
    assert order.tolist() == want
    assert new.tolist() == [True] + [cut[a] != cut[b] for a, b in zip(want, want[1:])]
    assert suffix.deep_shallow(b"", np.zeros(0, np.int64))[0].size == 0


def test_components(spark):
    random.seed(13)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_word_hashes_are_of_words():
    texts = [b"", b"  a b", b"x" * 3_000_000 + b" yy " + b"q " * 900_000, b"a b\tc\x0b", b"b"]
    h = list(word_hashes(texts))
    assert [len(x) for x in h] == [len(t.split()) for t in texts]
    assert h[1][0] == h[3][0] and h[1][1] == h[3][1] == h[4][0] and h[2][2] == h[2][3]
    a = np.arange(1, 200, dtype=U)
    assert (windows(np.concatenate([a[:3], a]), 50)[3:] == windows(a, 50)).all()


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs.cache()
        docs = stage(spark, before, folder)
        assert docs.columns == columns, name
        rows = [(r.doc_id, r.text) for r in before.collect()]
        after = {r.doc_id: r for r in docs.collect()}
        if name == "ngram_join":
            assert set(after) == {k for k, (_, c) in brute_join(rows).items() if k == c}
        if name == "suffix_dedup":
            want = brute_bytes(rows)
            assert all(after[k].text == v[3].decode(errors="ignore") and after[k].n_chars == len(after[k].text) for k, v in want.items())
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    packed = corpus_pipeline.pack(spark, docs, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(packed) == docs.count() and all(r.n == r.t for r in packed)


def test_release_leaves_the_tables_of_others(spark):
    mine, theirs = (f"test-{uuid.uuid4().hex}" for _ in range(2))
    with common.owned(mine):
        gone = common.written(spark.range(3), "mine")
    with common.owned(theirs):
        kept = common.written(spark.range(4), "theirs")
    file = gone.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(file)
    common.release(mine)
    assert kept.count() == 4 and not os.path.exists(file)
    common.release(theirs)
