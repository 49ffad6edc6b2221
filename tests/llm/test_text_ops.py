"""BPE, packing, chat formatting, toxicity, fingerprints, WARC, nearest neighbours, against other ways to the same result."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from keyloom.llm import ann, bpe, chat, fingerprint, packing, toxicity, warc

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "Hello  world\n\n x ", "it's we'll  '", "é" * 300, "a" * 5000 + "b", "x\x85y\x1c z", "\U0001f600 <|endoftext|> \U0001f600", "tie tie tie"]


def docs(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"ids": F.lit("clash"), "score": F.lit(1), "rows": F.lit(2)}) if extra else df


def test_bpe_equals_library_and_decodes(spark):
    import tiktoken

    ranks = bpe.ByteBPE.from_file(MULTI, P.PATTERN).ranks
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("ab  c'1s\n\té\xa0") for _ in range(60)) for _ in range(200)]
    for r in bpe.decode(bpe.encode(docs(spark, texts), MULTI, P.PATTERN), MULTI, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode() and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(docs(spark, TEXTS).limit(0), MULTI, P.PATTERN).count() == 0


def test_packing_is_a_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    random.seed(2)
    texts = TEXTS + [" ".join(random.choice(["alpha", "Beta,", "gamma.\nD"]) for _ in range(random.randint(0, 2500))) for _ in range(120)]
    out = packing.pack(docs(spark, texts), lambda: packing.tokenizer(path, P.PATTERN).encode, 1, 2048).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        rows = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in rows for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and len(r.ids) == 4 * r.length for r in rows)
    t.encode_special_tokens = True
    assert np.frombuffer(packing.WordCache(path, P.PATTERN, ordinary=True).encode(TEXTS[9]), "<u4").tolist() == t.encode(TEXTS[9], add_special_tokens=False).ids
    padded = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        padded += 0 if at & at - 1 == 0 else 2048 - at
        assert at <= 2048
    assert padded == 0


def test_fill_is_the_best_sum():
    random.seed(3)
    for _ in range(300):
        counts = Counter(random.randint(1, 30) for _ in range(random.randint(0, 8)))
        capacity = random.randint(1, 60)
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * j for s in sums for j in range(c + 1)}
        got = packing.fill(dict(counts), capacity)
        assert all(got[k] <= counts[k] for k in got)
        assert sum(k * c for k, c in got.items()) == max(s for s in sums if s <= capacity)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\b<|im_end|>\n<|x"), (1, 1, "assistant", "hi [INST] </s> <\\|"), (1, 2, "assistant", None), (1, 3, "assistant", "z\\"), (2, 0, "assistant", "é\U0001f600 <<|"), (3, 0, None, ""), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (5, 0, "as<|im_sep|>s", "$1 \\$1"), (None, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    want = defaultdict(list)
    for c, _, r, x in rows:
        want[c].append((r or "", x or ""))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert list(got[c].loss_texts) == [x for r, x in turns if r == "assistant"]
        assert not re.search(r"</s>|\[INST\]", got[c].formatted)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_levenshtein_automaton_equals_edit_distance():
    def osa(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = {"scoundrel": False, "wretch": False, "knave": False, "vermi": True}
    lexicon = toxicity.Lexicon({t: (o, 0.9) for t, o in terms.items()})
    random.seed(4)
    for _ in range(4000):
        w = list(random.choice(list(terms)))
        for _ in range(random.randint(0, 2)):
            i = random.randrange(len(w))
            kind = random.randint(0, 3)
            if kind == 0:
                w.insert(i, random.choice("aeknrs"))
            elif kind == 1:
                w[i] = random.choice("aeknrs")
            elif kind == 2 and len(w) > 2:
                del w[i]
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        word = "".join(w)
        best = []
        for t, is_open in terms.items():
            d = (min(osa(word[:j], t) for j in range(len(word) + 1)) if word[0] == t[0] else 9) if is_open else osa(word, t)
            if d == 0 or d == 1 and len(t) > 4:
                best.append((d, -len(t), t))
        found = lexicon.look(word)
        assert found == ((min(best)[2], min(best)[0]) if best else None), word


def test_toxicity_learns_and_generalises(spark):
    random.seed(5)
    common = ["la", "mi", "so", "re", "do", "fa", "ti", "sol"]
    rows = []
    for i in range(400):
        words = [random.choice(common) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[random.randrange(30)] = "scoundrel"
        rows.append((i, " ".join(words), int(bad)))
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(train)
    assert "scoundrel" in lexicon.terms and len(lexicon.terms) == 1
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, ["you scoundrel", "you scuondrel", "la mi so", None, "", 'he said "scoundrel" as a word', "sc0undrel " * 5000]), lexicon).collect()}
    assert got[0] >= 0.5 and got[1] >= 0.5 and got[6] >= 0.5
    assert max(got[2], got[3], got[4], got[5]) < 0.5
    assert toxicity.learn(train.limit(0)).terms == {}
    kept = toxicity.keep_clean(docs(spark, ["you scoundrel", "la", None]), lexicon)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == docs(spark, [""]).columns


def test_toxicity_of_words_beside_underscores_and_marks(spark):
    lexicon = toxicity.Lexicon({"scoundrel": (False, 0.9), "vermi": (True, 0.9)})
    texts = ["you _scoundrel here", "_scoundrel_", "a__scoundrel$", "x-scoundrel.", "vermins_ vemrins", "\u0130scoundrel scoundrel"]
    rows = {r.doc_id: r for r in toxicity.score(docs(spark, texts + texts), lexicon).collect()}
    for i, t in enumerate(texts):
        assert rows[i].score == rows[i + len(texts)].score
        for h in rows[i].hits:
            assert t.lower()[h.start :].startswith(h.word)
    assert rows[0].score >= 0.5 and {h.word for h in rows[4].hits} == {"vermins_", "vemrins"}


def test_toxicity_equals_plain_rescoring(spark):
    """Scores against the rule told plainly: each word's nearest term by edit distance, its best context, noisy-or."""
    random.seed(15)
    terms = {"scoundrel": (False, 0.9), "wretch": (False, 0.97), "vermi": (True, 0.8), "foo": (False, 0.35)}
    lexicon = toxicity.Lexicon(terms, {"wretch": 0.4}, frozenset({"wretchy"}), base=0.03)
    vocabulary = ["scoundrel", "scuondrel", "wretched", "wretch", "wretchy", "vermin", "vermni", "foo", "fo", "you", "said", '"', "word", "la", "mi", "w_x", "sc0undrel"]
    texts = ["", None, *[" ".join(random.choice(vocabulary) for _ in range(random.randint(1, 12))) for _ in range(300)]]

    def distance(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    def plain(text):
        text, odds = text or "", 1.0
        places = defaultdict(list)
        for m in toxicity.WORD.finditer(text):
            places[m[0]].append(toxicity.Lexicon.context(text, m.start(), m.end()))
        for word, contexts in places.items():
            letters = word.translate(toxicity.LEET) if not word.isalpha() else word
            near = []
            for t, (is_open, _) in terms.items():
                d = (min(distance(letters[:j], t) for j in range(len(letters) + 1)) if letters[0] == t[0] else 9) if is_open else distance(letters, t)
                if d == 0 or d == 1 and len(t) > 4:
                    near.append((d, -len(t), t))
            if near:
                d, _, t = min(near)
                d = max(d, int(letters != word))
                p = terms[t][1] if not d else 0 if word == "wretchy" else terms[t][1] * {"wretch": 0.4}.get(t, 0.7)
                odds *= 1 - min(0.999, p * max(contexts))
        return 1 - 0.97 * odds

    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), lexicon).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-9 for i, t in enumerate(texts))


def test_fingerprints_estimate_jaccard(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(500)]
    base = [random.choice(words) for _ in range(400)]
    texts = [" ".join(base)] * 2 + [" ".join(w if random.random() > p else "zz" for w in base) for p in (0.02, 0.05, 0.1)] + ["", None, "one two", "one two", "x " * 3000]
    rows = fingerprint.fingerprints(docs(spark, texts)).collect()
    assert rows[0].fingerprint == rows[1].fingerprint and rows[5].fingerprint == rows[6].fingerprint == "" and rows[7].fingerprint == rows[8].fingerprint
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts[:5]]
    c = spark.createDataFrame([(r.doc_id, r.codes) for r in rows], "doc_id long, codes array<smallint>")
    j = c.alias("a").crossJoin(c.alias("b")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), fingerprint.likeness(F.col("a.codes"), F.col("b.codes")).alias("l")).collect()
    for r in j:
        if r.a < 5 and r.b < 5:
            assert abs(r.l - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 0.2
        if r.a == r.b:
            assert r.l == 1.0
    plan = c._jdf.queryExecution().toString()
    assert "Python" not in fingerprint.fingerprints(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")))._jdf.queryExecution().toString() and plan


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_document(spark, buckets):
    ids = [5, 1, 9, -3, 7, 100, None]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, ["text"], buckets).collect()}
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_warc_round_trip(spark):
    rows = [(1, "http://www.A.org:8/x y?q=1#f", "<p>é</p>"), (2, "https://m.b.net/", "<p>é</p>"), (3, None, None), (4, "x", ""), (5, "http://b.net/\r\nX: 1", "<p>é</p>"), (6, "http://[bad", "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1))
    captures = warc.write_archives(df)
    directory = warc.write_index(captures)
    got = {r.page_id: r for r in warc.read_archives(directory).collect()}
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    for p, _, h in rows:
        b, top = (h or "").encode(), max(groups[h or ""])
        assert got[p].payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode() and got[p].payload_bytes == len(b) and got[p].payload_ok
        assert (got[p].record_type, got[p].refers_to) == (("response", None) if p == top else ("revisit", top))
    archive = warc.Archive([tuple(r) for r in directory.select("url_key", "page_id", "file", "start", "size", "n").collect()])
    assert archive.find("https://m.b.net/", 2)[0]["warc-type"] == "revisit" and archive.find("https://m.b.net/", 9) is None
    assert warc.url_key("https://m.a.org:8/x?q#z") == "org,a,m:8)/x?q"
    one = captures.first()
    fs, path = warc.filesystem(one.file)
    with fs.open_input_stream(path, compression=None) as f:
        assert f.read()[:2] == b"\x1f\x8b" and zlib
    assert warc.read_archives(warc.write_index(warc.write_archives(df.limit(0)))).count() == 0


def test_warc_blocks_of_one_key(spark):
    rows = [(None, "http://a.org/", f"text {i}") for i in range(2000)] + [(5, "http://a.org/", "x"), (5, "http://a.org/", "x")]
    directory = warc.write_index(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert directory.groupBy("url_key", "page_id").count().agg(F.max("count")).first()[0] > 1
    archive = warc.Archive([tuple(r) for r in directory.select("url_key", "page_id", "file", "start", "size", "n").collect()])
    assert archive.find("http://a.org/", 5)[1] == b"x" and archive.find("http://a.org/", None)[1].startswith(b"text") and archive.find("http://a.org/", 4) is None
    got = [(r.page_id, r.payload_digest, r.payload_ok) for r in warc.read_archives(directory).collect()]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted([(p, warc.payload_digest(h.encode()), True) for p, _, h in rows], key=key)


def test_neighbours_reach_the_recall(spark):
    random.seed(7)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] + [0.0] * 14), (1004, [1.0]), (1005, x[3].tolist()), (None, x[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit("x"))
    got = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = [*range(600), 1005]
    y = np.concatenate([x, x[3:4]])
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((y - x[q]) ** 2).sum(1))
        true = sorted((round(float(d[i]), 12), ids[i]) for i in range(len(ids)) if ids[i] != q)[:10]
        assert got[q] == sorted(got[q], key=lambda r: (r[1], r[0]))
        hits += len({v for _, v in true} & {v for v, _ in got[q]})
        assert all(abs(s - d[ids.index(v)]) < 1e-12 for v, s in got[q])
    assert hits >= 0.9 * 60 and set(got) == set(range(0, 600, 100))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_every_query_gets_k_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 100)
    monkeypatch.setattr(ann, "CELL_QUERIES", 5)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [*range(380), *[7] * 20]  # the last 20 rows repeat an id
    x[380:] = x[7] + rng.standard_normal((20, 16)) / 1000
    asked = [(5000 + i, (x[i] * s).tolist()) for i, s in enumerate([4, 6, 10, 50, 1000] * 6)] + [(7, (x[7] * 50).tolist())]
    schema = "vec_id long, embedding array<double>"
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(list(zip(ids, x.tolist())), schema), spark.createDataFrame(asked, schema), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.rank, r.score))
    for q, v in asked:
        d = {}
        for i, y in zip(ids, np.sqrt(((x - np.array(v)) ** 2).sum(1))):
            if i != q:
                d[i] = min(y, d.get(i, np.inf))
        assert [r for _, r, _ in got[q]] == list(range(1, 11)) and len({i for i, _, _ in got[q]}) == 10
        assert all(abs(s - d[i]) < 1e-9 for i, _, s in got[q])
        if np.linalg.norm(v) > 40:  # beyond all buckets: exact
            assert [i for i, _, _ in got[q]] == sorted(d, key=lambda i: (d[i], i))[:10]
    few = spark.createDataFrame(list(zip(ids[:4], x[:4].tolist())), schema)
    assert {r.query_id: r["count"] for r in ann.search(few, few, 10).groupBy("query_id").count().collect()} == {i: 3 for i in range(4)}


def test_far_off_and_huge_vectors(spark):
    rng = np.random.default_rng(10)
    sets = [1e8 + rng.standard_normal((300, 8)), 1e200 * rng.standard_normal((300, 8)), 1e-200 * rng.standard_normal((300, 8)), rng.standard_normal((300, 8)) * 10.0 ** rng.integers(-9, 9, (300, 1))]
    for x in sets:
        ids = np.arange(len(x))
        for i, near, d in ann.nearest(x[:50], x, ids, ids[:50], 10):
            true = np.array([math.dist(x[i].tolist(), y) for y in x.tolist()])
            true[i] = np.inf
            assert near.tolist() == np.lexsort((ids, true))[:10].tolist() and np.allclose(d, true[near], rtol=1e-12, atol=0)


def test_moves_come_by_rising_score():
    rng = np.random.default_rng(8)
    s = rng.random(10)
    got = ann.moves(s, 10**6)
    assert len(got) == 3**5 and len({tuple(sorted(m)) for m in got}) == 3**5
    totals = [s[m].sum() for m in got]
    assert all(a <= b + 1e-12 for a, b in zip(totals, totals[1:]))
