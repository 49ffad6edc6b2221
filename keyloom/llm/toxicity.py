"""Toxicity scoring with a learned lexicon, Levenshtein automata and context windows.

The lexicon is a trie of terms learned from labelled texts: whole words, and stems that take any ending.
A word is looked up by running the Levenshtein automaton of the word against the trie, which follows only
branches that can still come within one edit (neighbours swapped count as one), so misspelled terms are
caught too. A word that can be no term's neighbour is passed over after two set lookups. Each hit's
window of surrounding text tells quotation and report from abuse and weighs the hit; hits join by
noisy-or.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import kept, small_batches, texts, two

#: Lengths of stems tried, labelled rows that the lexicon is fitted on at most, least precision of a term.
STEM, SAMPLE_ROWS, PRECISION = (4, 12), 4000, 0.8
#: Terms met in clean texts too count for less below this precision, so that one alone decides nothing.
SURE, HINT = 0.95, 0.35
WORD = re.compile(r"[^\W_][\w@$]*")
#: Words whose lookups a worker keeps, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 400_000, 40
#: Characters that stand for letters inside words.
LEET = str.maketrans("013457@$", "oieastas")
QUOTES = "\"'“”„«»‘’`"
REPORTS = re.compile(r"\b(?:said|says|wrote|writes|called|calls|quote[ds]?|term|word|slur|insult|defin\w+|mention\w*|cited|report\w*|sagte|schrieb|nannte|wort|zitat|begriff|dit|écrit|appelé|mot|terme|citation|dijo|escribió|llamó|palabra|término|cita)\b")
AIMED = re.compile(r"\b(?:you|your|you're|yours|du|dich|dein\w*|ihr|tu|te|toi|vous|votre|ton|tú|ti|usted|ustedes|vosotros)\b")
WINDOW = 80


class Trie:
    """Lexicon terms by letter; a term that is open matches with any ending."""

    def __init__(self, terms: dict[str, bool]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        for term, is_open in terms.items():
            at = 0
            for ch in term:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                at = self.children[at][ch]
            self.ends[at] = (term, is_open)


def automaton(word: str, trie: Trie, edits: int = 1) -> tuple[str, int] | None:
    """The term nearest to ``word`` within ``edits``, and its distance; ties to the longer, then the first in order.

    A state is a row of the edit table: the distances of the trie path to every prefix of the word. A
    branch is left when no entry is within ``edits``. An open term may stop at any prefix of the word,
    but must begin with its letter: stems are short, and with that too open other words come near them.
    """
    best: tuple[int, int, str] | None = None
    start = tuple(range(len(word) + 1))
    stack: list[tuple[int, str, tuple, tuple]] = [(0, "", start, ())]
    while stack:
        node, last, row, above = stack.pop()
        end = trie.ends[node]
        if end:
            term, is_open = end
            d = row[-1] if not is_open else min(row) if word[:1] == term[:1] else edits + 1
            if d <= edits and (d == 0 or len(term) > 4):
                best = min(best or (d, -len(term), term), (d, -len(term), term))
        for ch, child in trie.children[node].items():
            new = [row[0] + 1]
            for j, w in enumerate(word, 1):
                d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != ch))
                if above and j > 1 and w == last and word[j - 2] == ch:
                    d = min(d, above[j - 2] + 1)
                new.append(d)
            if min(new) <= edits:
                stack.append((child, ch, tuple(new), row))
    return (best[2], best[0]) if best else None


@dataclass
class Lexicon:
    """Terms with their precision, how far a misspelling of each is trusted, and words that are none."""

    terms: dict[str, tuple[bool, float]] = field(default_factory=dict)
    misspelled: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    base: float = 0.02

    def __post_init__(self) -> None:
        self.trie = Trie({t: o for t, (o, _) in self.terms.items()})
        # One edit (or swap) leaves the first or the last half of a term's letters as they were; those of a stem may
        # then lie one to either side of their place.
        self.stems = frozenset(t for t, (is_open, _) in self.terms.items() if is_open)
        self.stem_lengths = sorted({len(t) for t in self.stems})
        near: dict[int, dict[int, tuple[set[str], set[str]]]] = defaultdict(lambda: defaultdict(lambda: (set(), set())))
        halves: dict[tuple, set[tuple[str, str]]] = defaultdict(set)
        for t, (is_open, _) in self.terms.items():
            n = max(2, (len(t) - 1) // 2)
            if not is_open:
                for length in range(len(t) - 1, len(t) + 2):
                    near[length][n][0].add(t[:n])
                    near[length][n][1].add(t[-n:])
            elif len(t) > 4:
                halves["first", 0, n, len(t)].add((t[:n], t))
                for at in range(len(t) - n - 1, len(t) - n + 2):
                    halves["last", at, at + n, len(t)].add((t[-n:], t))
        self.near = {length: [(n, h, t) for n, (h, t) in by.items()] for length, by in near.items()}
        self.halves = {(i, j): frozenset(x for key in halves if key[1:3] == (i, j) for x, _ in halves[key]) for _, i, j, _ in halves}
        self.begins = frozenset(t[:1] for t in self.stems)
        self.letters = {t: Counter(t) for t in self.stems}
        self.seen: dict[str, tuple[str, int] | None] = {}
        self.key = uuid.uuid4().hex

    def held(self) -> Lexicon:
        """This lexicon as the worker process holds it, so that its tasks share what words gave."""
        return kept(("lexicon", self.key), lambda: self)

    def possible(self, plain: str) -> bool:
        """Whether the letters of a word leave a term within one edit possible."""
        if any(plain[:n] in self.stems for n in self.stem_lengths):
            return True
        if any(plain[:n] in h or plain[-n:] in t for n, h, t in self.near.get(len(plain), ())):
            return True
        if plain[:1] not in self.begins or not any(plain[i:j] in x for (i, j), x in self.halves.items()):
            return False
        # A stem within one edit has at most one letter that the word's beginning lacks.
        return any(plain[0] == t[0] and (letters - Counter(plain[: len(t) + 1])).total() <= 1 for t, letters in self.letters.items())

    def look(self, word: str) -> tuple[str, int] | None:
        """The term that a lower-case word is or misspells, and the distance; what a word gave is kept.

        Only words whose letters leave a term possible are run against the trie.
        """
        if word in self.seen:
            return self.seen[word]
        plain = word if word.isalpha() else word.translate(LEET)
        found = automaton(plain, self.trie) if self.possible(plain) else None
        if found:
            found = found[0], max(found[1], int(plain != word))
        if len(self.seen) >= KEPT_WORDS:
            self.seen.clear()
        if len(word) <= KEPT_LENGTH:
            self.seen[word] = found
        return found

    def weight(self, word: str, term: str, edits: int) -> float:
        if edits == 0:
            return self.terms[term][1]
        return 0.0 if word in self.clean else self.misspelled.get(term, 0.7) * self.terms[term][1]

    def score(self, text: str) -> tuple[float, list[dict]]:
        """The score of a whole text and its hits."""
        low = text.lower()
        hits, odds, matched = [], 1.0, {}
        for word in set(WORD.findall(low)) if self.terms else ():
            found = self.look(word)
            if found and (p := self.weight(word, *found)) > 0:
                matched[word] = found, p, []
        if matched:
            for m in WORD.finditer(low):
                if m[0] in matched:
                    matched[m[0]][2].append((m.start(), m.end()))
            for word, (found, p, places) in matched.items():
                # Of all places of the word, the one least like a quotation counts.
                context, place = max((self.context(low, i, j), -i) for i, j in places)
                hits.append({"term": found[0], "word": word, "edits": found[1], "start": -place, "context": context})
                odds *= 1 - min(0.999, p * context)
        hits.sort(key=lambda h: (h["start"], h["word"]))
        return 1 - (1 - self.base) * odds, hits

    @staticmethod
    def context(low: str, start: int, stop: int) -> float:
        """How far the window speaks of abuse: under 1 where the word is quoted or reported, 1 otherwise."""
        before, after = low[max(0, start - WINDOW) : start], low[stop : stop + WINDOW]
        quoted = before[-1:] in QUOTES and after[:1] in QUOTES and bool(before) and bool(after)
        if not quoted:
            for q, e in (("“", "”"), ("„", "“"), ("«", "»"), ('"', '"')):
                inside = before.rfind(q) > before.rfind(e) if q != e else before.count(q) % 2 == 1
                quoted = quoted or inside and e in after
        reported = bool(REPORTS.search(before) or REPORTS.search(after))
        if AIMED.search(before) or AIMED.search(after):
            return 1.0 if not (quoted and reported) else 0.6
        return 0.3 if quoted and reported else 0.6 if quoted else 1.0


def _words(text: str):
    return F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}@$]+", " ")), " "))


def learn(labelled: DataFrame, label: str = "toxic", text: str = "text", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from labelled texts: the first ``sample_rows`` rows by a hash of ``order`` are used.

    Words and word beginnings are counted once in each text, by label. A term must be significant (so
    often in toxic texts that chance gives less than 0.05 such terms among all that were counted) and reach the precision. Of a chain
    of beginnings the longest that keeps 0.9 of the texts is taken; a whole word, if it does. Without
    texts of both labels the lexicon is empty.
    """
    rows = labelled.select(F.coalesce(labelled[text], F.lit("")).alias("text"), (labelled[label] == 1).cast("int").alias("y"), labelled[order].alias("o")).filter("y is not null")
    rows = rows.orderBy(F.xxhash64("o"), "o").limit(sample_rows).select("text", "y").cache()
    try:
        n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
        if not n.t or n.t == n.n:
            return Lexicon(base=0.02)
        begin = F.flatten(F.transform(_words("text"), lambda w: F.when(F.char_length(w) >= 3, F.array_append(F.transform(F.sequence(F.lit(STEM[0]), F.greatest(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.char_length(w)))), lambda i: F.substring(w, F.lit(1), i)), F.concat(w, F.lit("$"))) ).otherwise(F.array().cast("array<string>"))))
        counts = rows.select("y", F.explode(F.array_distinct(begin)).alias("f")).groupBy("f").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
        rate = n.t / n.n
        least = max(3, math.ceil(math.log(max(1, counts.count()) / 0.05) / math.log(1 / rate)))
        found = {r.f: (r.t, r.c) for r in counts.filter((F.col("t") >= least) & ((F.col("t") + 0.5) / (F.col("t") + F.col("c") + 1) >= PRECISION)).collect()}
        terms = _choose(found)
        lexicon = Lexicon(terms)
        near = defaultdict(lambda: [0, 0])
        clean = set()
        for r in near_misses(rows, lexicon).groupBy("term", "word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).collect():
            if r.c and (r.t + 0.5) / (r.t + r.c + 1) < PRECISION:
                clean.add(r.word)
            else:
                near[r.term][0] += r.t
                near[r.term][1] += r.c
        return Lexicon(terms, {k: (t + 0.7) / (t + c + 1) for k, (t, c) in near.items()}, frozenset(clean), base=0.1 * rate)
    finally:
        rows.unpersist()


def _choose(found: dict[str, tuple[int, int]]) -> dict[str, tuple[bool, float]]:
    below: dict[str, list[str]] = defaultdict(list)
    for f in found:
        stem = f.removesuffix("$")
        parents = [stem[:i] for i in range(len(stem) - (not f.endswith("$")), STEM[0] - 1, -1) if stem[:i] in found]
        below[parents[0] if parents else ""].append(f)
    terms = {}
    stack = list(below[""])
    while stack:
        f = stack.pop()
        heirs = [h for h in below[f] if found[h][0] >= 0.9 * found[f][0]]
        if heirs:
            stack.append(max(heirs, key=lambda h: (found[h][0], h.endswith("$"), h)))
        else:
            t, c = found[f]
            sure = (t + 0.5) / (t + c + 1)
            terms[f.removesuffix("$")] = (not f.endswith("$"), sure if not c or sure >= SURE else HINT)
    return terms


def near_misses(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """term, word, y of every misspelled hit, once in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for t, y in zip(texts(b), b.column("y").to_pylist()):
                for w in set(WORD.findall(t.lower())):
                    found = lexicon.look(w)
                    if found and found[1]:
                        out.append((found[0], w, y))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["term", "word", "y"])

    return rows.mapInArrow(run, "term string, word string, y int")


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, hits of every whole text: one row for each row, nothing shuffled.

    hits: array of term, word, edits, start, context. Null and empty texts have no hits and the score of
    a text without hits; null and repeated keys stay as they are; other columns are ignored.
    """
    hit = pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("edits", pa.int32()), ("start", pa.int64()), ("context", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lexicon.held()
        for b in small_batches(batches):
            found = [of.score(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([h for _, h in found], hit)], ["doc_id", "score", "hits"])

    return two(docs, key, text).mapInArrow(run, "doc_id long, score double, hits array<struct<term:string,word:string,edits:int,start:long,context:double>>")


def held_out(key):
    """Rows that labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def learn_from(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the labels that aren't held out, of a document with several the largest; at most SAMPLE_ROWS are sent to the documents."""
    train = labels.filter(~held_out(labels["doc_id"]) & labels["toxic"].isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id")
    return learn(rows)


def keep_clean(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under the threshold; null texts stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lexicon.held()
        for b in small_batches(batches):
            yield b.filter(pa.array([of.score(t or "")[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
