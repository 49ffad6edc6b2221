"""Set-similarity self-join on word shingles by prefix filters under several token orders.

A document's set is its distinct runs of five words (lower-cased A-Z); two sets whose Jaccard similarity
reaches t share a token among the first n - ceil(t n) + 1 of each under any one order of all tokens.
The first order puts frequent tokens last and is the index: prefix tokens are shuffled once, and sets
that share one meet. There a bitmap bound on the intersection and the lengths leave few candidates.
Candidates must then share a prefix token under two other orders, and what passes all is verified
by exact intersection.

Equal sets are one entity, so copies meet nowhere. To keep families of near copies from giving all their
pairs, a group of sets that share a token first gives a spanning tree of its candidates; only where
verification leaves a group in several components are its other candidates across components verified
too, so that no link between components is lost. Very large groups are compared in cells.

All links are then within the components so found. There every two sets whose lengths let them link are
compared exactly, in cells of bounded size that each get a set once: ngram_join() counts each document's
links, and join_sets() lists every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import forget, partitions_for, small_batches, two, written
from keyloom.llm.components import components
from keyloom.llm.words import LOWER, U, mix, windows, word_hashes

#: Words in a shingle; similarity as hundredths; sets of a group that are compared in one cell.
WORDS, PERCENT, CELL = 5, 80, 4096
#: Sets, and tokens of them, of a component that make one side of a cell where all links are found; tokens counted at once there.
SIDE_SETS, SIDE_TOKENS, COLUMNS = 1024, 1 << 21, 2048
#: A token in more than one of FREQUENT sets goes last in the index order; at most MOST_FREQUENT such tokens are sent along.
FREQUENT, MOST_FREQUENT = 2048, 500_000
#: Bits for each token of the bitmaps of sets that have candidates.
WIDE = 8
#: Further token orders that candidates are filtered by.
ORDERS = (U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47))


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's set: sorted distinct hashes of its shingles; of fewer words, one of the whole sequence; else empty."""
    for h in word_hashes([t.encode().translate(LOWER) for t in texts]):
        if len(h) >= words:
            yield np.unique(windows(h, words))
        elif len(h):
            yield mix(windows(h, len(h)) ^ U(len(h)))
        else:
            yield h


def set_id(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def least_common(a, b, percent: int = PERCENT):
    """The least intersection of sets of these sizes that makes a link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def bits_of(s: np.ndarray, each: int = 1) -> bytes:
    """A bitmap of ``each`` to twice as many bits for each token, of a power of two of bits."""
    m = 64
    while m < each * len(s):
        m *= 2
    out = np.zeros(m // 8, np.uint8)
    at = (s >> U(17)) & U(m - 1)
    np.bitwise_or.at(out, (at >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & U(7)).astype(np.uint8)))
    return out.tobytes()


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens found in many sets, ascending, and in how many.

    Each batch reports tokens that are frequent in it; sums over all documents decide. A token can be
    missed that is frequent overall but in no batch; any order of tokens gives right results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in small_batches(batches, 4096):
            sets = list(shingle_sets([t or "" for t in b.column("text").to_pylist()]))
            t, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.array([], U), np.array([], np.int64))
            keep = c >= max(3, b.num_rows // 512)
            yield pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], ["token", "c"])

    n = docs.count()
    rows = docs.select("doc_id", "text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    got = rows.filter(F.col("c") >= max(16, n // FREQUENT)).orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).toArrow()
    t, c = np.asarray(got["token"]).view(U), np.asarray(got["c"])
    order = np.argsort(t)
    return t[order], c[order]


def profiles(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, e (the set's hash; null if empty), n, prefix (under the index order), bits."""
    hot, count = frequent_tokens(docs)
    sent = docs.sparkSession.sparkContext.broadcast((hot, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hot, count = sent.value
        for b in small_batches(batches, 1024):
            e, n, prefix, bits = [], [], [], []
            for s in shingle_sets([t or "" for t in b.column("text").to_pylist()]):
                n.append(len(s))
                e.append(set_id(s))
                bits.append(bits_of(s) if len(s) else None)
                p = prefix_length(len(s), percent)
                if len(hot) and len(s):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    if is_hot[: p + 1].any() or is_hot.sum() > len(s) - p:
                        cold = s[~is_hot][:p]
                        late = s[is_hot]
                        s = np.concatenate([cold, late[np.lexsort((late, count[at[is_hot]]))][: p - len(cold)]])
                prefix.append(s[:p].view(np.int64))
            lengths = np.cumsum([0, *map(len, prefix)])
            flat = np.concatenate(prefix) if prefix else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(e, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), pa.array(bits, pa.binary())],
                ["doc_id", "e", "n", "prefix", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, e long, n long, prefix array<long>, bits binary")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.array([0])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew, so that rows with one key are in one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(key))
        cut = int(_runs(keys)[-2])
        if held and cut == 0 and np.asarray(held[-1].column(key))[-1] == keys[0]:
            held.append(b)
            continue
        if cut == 0:
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = [b]
            continue
        yield from pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()
        held = [b.slice(cut)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """token, e, block of the tokens that two sets or more have; each CELL sets of a token are a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = None  # the last row so far: token, e, its place in the group, whether it was given
        for b in batches:
            t, e = np.asarray(b.column("token")), np.asarray(b.column("e"))
            if not len(t):
                continue
            if held:
                t, e = np.concatenate([[held[0]], t]), np.concatenate([[held[1]], e])
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (e[1:] != e[:-1])])
            t, e = t[new], e[new]
            starts = _runs(t)
            size = np.diff(starts)
            rank = np.arange(len(t)) - np.repeat(starts[:-1], size)
            keep = np.repeat(size > 1, size)
            if held:
                rank[: size[0]] += held[2]
                keep[0] &= not held[3]
            alone = held and len(t) == 1
            held = (int(t[-1]), int(e[-1]), int(rank[-1]), held[3] if alone else bool(keep[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(e[keep]), pa.array((rank[keep] // CELL).astype(np.int32))], ["token", "e", "block"])

    n = partitions_for(tokens)
    return tokens.repartition(n, "token").sortWithinPartitions("token", "e").mapInArrow(run, "token long, e long, block int")


def candidates(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows can be links, and how far apart their bitmaps are.

    A bit that one set has and the other hasn't stands for at least one token that only the first has.
    The longer bitmap is folded to the shorter.
    """
    need = least_common(n[i], n[j], percent)
    ok = np.minimum(n[i], n[j]) >= need
    apart = np.zeros(len(i), np.int64)
    size = np.array([len(b) for b in bits], np.int64)
    rows = np.flatnonzero(ok)
    for m in np.unique(np.minimum(size[i[rows]], size[j[rows]])):
        at = rows[np.minimum(size[i[rows]], size[j[rows]]) == m]
        used, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        folded = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[k], U).reshape(-1, int(m) // 8), axis=0) for k in used])
        count = np.bitwise_count(folded).sum(1).astype(np.int64)
        a, b = back[: len(at)], back[len(at) :]
        step = max(16, (1 << 24) // int(m))
        for s in range(0, len(at), step):
            x, y = a[s : s + step], b[s : s + step]
            both = np.bitwise_count(folded[x] & folded[y]).sum(1).astype(np.int64)
            k = at[s : s + step]
            ok[k] = (n[i[k]] - (count[x] - both) >= need[k]) & (n[j[k]] - (count[y] - both) >= need[k])
            apart[k] = count[x] + count[y] - 2 * both
    return ok, apart


def _tree(g: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The edges (by number) of a least spanning forest."""
    parent = list(range(g))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(apart, kind="stable").tolist():
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            parent[a] = b
            out.append(k)
    return np.array(out, np.int64)


def _pairs(groups: DataFrame, across: bool, percent: int) -> DataFrame:
    """Compare the sets of each group (token and cell): rows a, b, token.

    Without ``across``: a spanning forest of each group's candidates, and, where it has more candidates, a row
    for each set concerned with b null. With it: all candidates between sets of different components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in _whole_groups(batches, "cell"):
            cell, token, e, n, side = (np.asarray(b.column(c)) for c in ("cell", "token", "e", "n", "side"))
            comp = np.asarray(b.column("comp")) if across else None
            bits = b.column("bits").to_pylist()
            starts = _runs(cell)
            size = np.diff(starts)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            more: list[np.ndarray] = []

            def look(i: np.ndarray, j: np.ndarray, whole: bool) -> None:
                fit = (side[i] | side[j]) == 3 if len(i) else np.zeros(0, bool)
                if across:
                    fit &= comp[i] != comp[j]
                i, j = i[fit], j[fit]
                ok, apart = candidates(n, bits, i, j, percent)
                i, j, apart = i[ok], j[ok], apart[ok]
                if whole and len(i) and not across:
                    nodes, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                    tree = _tree(len(nodes), back[: len(i)], back[len(i) :], apart)
                    if len(tree) < len(i):
                        more.append(nodes)
                    i, j = i[tree], j[tree]
                out.append((e[i], e[j], token[i]))

            for g in np.unique(size[size < 9]):
                if g < 2:
                    continue
                a, c = np.triu_indices(g, 1)
                at = starts[:-1][size == g]
                for s in range(0, len(at), 4096):
                    base = at[s : s + 4096, None]
                    if g == 2:
                        look((base + a).ravel(), (base + c).ravel(), False)
                    else:
                        i, j = (base + a).ravel(), (base + c).ravel()
                        look(i, j, False)
            for s, g in zip(starts[:-1][size >= 9].tolist(), size[size >= 9].tolist()):
                order = s + np.argsort(n[s : s + g], kind="stable")
                reach = np.searchsorted(n[order], n[order] * 100 // percent + 1)  # sorted by size: no set beyond can link
                i = np.repeat(np.arange(g), np.maximum(reach - np.arange(g) - 1, 0))
                first = np.cumsum(np.concatenate([[0], np.maximum(reach - np.arange(g) - 1, 0)]))[:-1]
                j = np.arange(len(i)) - np.repeat(first, np.maximum(reach - np.arange(g) - 1, 0)) + i + 1
                look(order[i], order[j], True)
            rest = [(e[k], None, token[k]) for k in more]
            a = np.concatenate([x[0] for x in (*out, *rest)]) if out or rest else np.array([], np.int64)
            t = np.concatenate([x[2] for x in (*out, *rest)]) if out or rest else np.array([], np.int64)
            c = np.concatenate([x[1] if x[1] is not None else np.zeros(len(x[0]), np.int64) for x in (*out, *rest)]) if out or rest else np.array([], np.int64)
            none = np.concatenate([np.full(len(x[0]), x[1] is None) for x in (*out, *rest)]) if out or rest else np.array([], bool)
            lo, hi = np.where(none, a, np.minimum(a, c)), np.maximum(a, c)
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi, mask=none), pa.array(t)], ["a", "b", "token"])

    return groups.repartition(partitions_for(groups), "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, token long")


def _cells(groups: DataFrame) -> DataFrame:
    """Rows of groups (token, e, block, ...) with cell and side: tokens of one block are one cell, those of more a cell for each two blocks."""
    blocks = groups.filter("block > 0").groupBy("token").agg((F.max("block") + 1).alias("blocks"))
    if blocks.isEmpty():
        return groups.withColumns({"cell": F.col("token"), "side": F.lit(3)})
    g = groups.join(blocks, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    g = g.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    cell = F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", lo, hi))
    side = F.when(lo == hi, 3).when(F.col("block") == lo, 1).otherwise(2)
    return g.withColumns({"cell": cell, "side": side}).drop("blocks", "other")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of entities that are links: prefix filters under the other orders, then exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in small_batches(batches):
            cols = {c: b.column(c).to_pylist() for c in ("sa", "sb", "pa", "pb")}
            keep = []
            for sa, sb, fa, fb in zip(*cols.values()):
                for x, y in zip(fa, fb):
                    if not len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)):
                        keep.append(False)
                        break
                else:
                    x, y = np.frombuffer(sa, U), np.frombuffer(sb, U)
                    keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= least_common(len(x), len(y), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    one = sets.select(F.col("e").alias("a"), F.col("s").alias("sa"), F.col("p").alias("pa"))
    two_ = sets.select(F.col("e").alias("b"), F.col("s").alias("sb"), F.col("p").alias("pb"))
    return pairs.join(one, "a").join(two_, "b").select("a", "b", "sa", "sb", "pa", "pb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, percent: int) -> DataFrame:
    """e, s (the set), p (its prefixes under the other orders), bits (a wide bitmap) of text, e; a null e stands for whatever the text gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in small_batches(batches):
            es, s, p, bits = [], [], [], []
            for x, e in zip(shingle_sets([t or "" for t in b.column("text").to_pylist()]), b.column("e").to_pylist()):
                own = set_id(x)
                if own is None or e not in (None, own):
                    continue  # another row with the same doc_id
                e = own
                k = prefix_length(len(x), percent)
                es.append(e)
                bits.append(bits_of(x, WIDE))
                s.append(x.tobytes())
                p.append([np.sort(x[np.argsort(mix(x ^ o))[:k]]).tobytes() for o in ORDERS])
            yield pa.RecordBatch.from_arrays([pa.array(es, pa.int64()), pa.array(s, pa.binary()), pa.array(p, pa.list_(pa.binary())), pa.array(bits, pa.binary())], ["e", "s", "p", "bits"])

    return docs.select("text", "e").mapInArrow(run, "e long, s binary, p array<binary>, bits binary")


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Which sets (by number) link, by the exact intersections of all: those of side 3 with each other, those of side 1 with those of side 2."""
    n = np.array([len(x) for x in sets], np.int64)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # tokens of one set meet nothing
    keep = count[col] > 1
    row, col = np.repeat(np.arange(len(sets)), n)[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    both = np.zeros((len(left), len(right)), np.int64)
    for s in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [s, s + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, int(col[-1]) + 1 - s)), np.float32)
        has[row[lo:hi], col[lo:hi] - s] = 1
        both += (has[left] @ has[right].T).astype(np.int64)
    i, j = np.nonzero(both >= least_common(n[left][:, None], n[right][None], percent))
    i, j = left[i], right[j]
    once = (i < j) | (side[i] != 3)
    return i[once], j[once]


def _links_within(joined: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, listed: bool) -> DataFrame:
    """All links between the sets of each component (node, root): listed as a < b, or else counted as e, n_links, n_sets.

    n_links counts the rows whose sets a set links with, n_sets the sets, each other one. A component is one cell. A larger one has its sets in bands of length, where only sets of one band or of
    neighbouring ones can link, and each band in parts; every two parts that can link are a cell.
    """
    at = joined.join(reps.select(F.col("e").alias("node"), "n"), "node").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / min(percent, 95)))))
    size = [F.count("*").alias("c"), F.sum("n").alias("t")]
    at = written(at, "members")
    large = at.groupBy("root").agg(*size).filter((F.col("c") > SIDE_SETS) | (F.col("t") > SIDE_TOKENS)).select("root")
    small = at.join(large, "root", "left_anti").select(F.col("node").alias("e"), F.col("root").alias("cell"), F.lit(3).alias("side"))
    bands = at.join(large, "root", "left_semi").groupBy("root", "band").agg(*size)
    bands = written(bands.select("root", "band", F.greatest(F.ceil(F.col("c") / SIDE_SETS), F.ceil(F.col("t") / SIDE_TOKENS)).cast("int").alias("parts")), "bands")
    by = lambda name, shift: bands.select("root", (F.col("band") + shift).alias("band"), F.col("parts").alias(name))
    x = at.join(by("parts", 0), ["root", "band"]).join(by("under", 1), ["root", "band"], "left").join(by("over", -1), ["root", "band"], "left")
    x = x.withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def cells(parts: str, low, i, j, step: int, side):
        """A set's cells with the parts of a band: of band ``low`` and that ``step`` above it, parts i and j."""
        each = F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(0)))
        return F.transform(F.filter(each, lambda k: k < F.coalesce(F.col(parts), F.lit(0))), lambda k: F.struct(F.xxhash64("root", low, i(k), j(k), F.lit(step)).alias("cell"), side(k).alias("side")))

    own, band = F.col("i"), F.col("band")
    same = cells("parts", band, lambda k: F.least(own, k), lambda k: F.greatest(own, k), 0, lambda k: F.when(k == own, 3).when(own < k, 1).otherwise(2))
    over = cells("over", band, lambda k: own, lambda k: k, 1, lambda k: F.lit(1))
    under = cells("under", band - 1, lambda k: k, lambda k: own, 1, lambda k: F.lit(2))
    split = x.select(F.col("node").alias("e"), F.inline(F.concat(same, over, under)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in _whole_groups(batches, "cell"):
            side, copies, s = np.asarray(b.column("side")), np.asarray(b.column("copies")), b.column("s")
            links, near = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            starts = _runs(np.asarray(b.column("cell")))
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                i, j = linked([np.frombuffer(y, U) for y in s.slice(lo, hi - lo).to_pylist()], side[lo:hi], percent)
                for x, y in ((lo + i, lo + j), (lo + j, lo + i)):
                    np.add.at(links, x, copies[y])
                    np.add.at(near, x, 1)
            yield pa.RecordBatch.from_arrays([b.column("e"), pa.array(links), pa.array(near)], ["e", "n_links", "n_sets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in _whole_groups(batches, "cell"):
            e, side, s = np.asarray(b.column("e")), np.asarray(b.column("side")), b.column("s")
            starts = _runs(np.asarray(b.column("cell")))
            out = [(np.array([], np.int64),) * 2]
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                i, j = linked([np.frombuffer(y, U) for y in s.slice(lo, hi - lo).to_pylist()], side[lo:hi], percent)
                out.append((e[lo + i], e[lo + j]))
            x, y = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    groups = small.unionByName(split).join(sets.select("e", "s"), "e").join(reps.select("e", "copies"), "e")
    groups = groups.repartition(partitions_for(groups), "cell").sortWithinPartitions("cell")
    if listed:
        return groups.mapInArrow(run, "a long, b long")
    return groups.mapInArrow(count, "e long, n_links long, n_sets long").groupBy("e").agg(F.sum("n_links").alias("n_links"), F.sum("n_sets").alias("n_sets"))


def _joined(d: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of doc_id, text: profiles of the rows; the different sets; those with links, by node and root of their component; the sets' tokens."""
    p = written(profiles(d, percent), "profiles")
    reps = written(p.filter("e is not null").groupBy("e").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies")), "sets")
    shared = written(shared_tokens(p.filter("e is not null").select("e", F.explode("prefix").alias("token"))), "shared")
    groups = _cells(shared).join(reps.select("e", "n", "bits"), "e")
    found = written(_pairs(groups, False, percent), "pairs")
    pairs = written(found.filter("b is not null").select("a", "b").distinct(), "candidates")
    need = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct()
    ids = need.join(reps.select("e", "doc_id"), "e")
    texts = _sets(d.join(ids, "doc_id"), percent)
    unnamed = ids.filter("doc_id is null").select("e")  # sets of rows without an id only: their texts are found by the set
    if not unnamed.isEmpty():
        nulls = _sets(d.filter("doc_id is null").withColumn("e", F.lit(None).cast("long")), percent)
        texts = texts.unionByName(nulls.join(unnamed, "e", "left_semi"))
    sets = written(texts.dropDuplicates(["e"]), "tokens")
    links = written(verified(pairs, sets, percent), "links")
    joined = written(components(links, "a", "b"), "components")
    open_ = found.filter("b is null").select("token", F.col("a").alias("e")).distinct().join(joined.select(F.col("node").alias("e"), "root"), "e", "left").withColumn("comp", F.coalesce("root", "e")).drop("root")
    several = open_.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rest = written(open_.join(several, "token"), "open")
    if not rest.isEmpty():
        block = shared.select("token", "e", "block")
        wide = reps.select("e", "n").join(sets.select("e", "bits"), "e")
        again = _cells(rest.join(block, ["token", "e"])).join(wide, "e")
        more = _pairs(again, True, percent).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        late = written(verified(more, sets, percent), "late-links")
        if not late.isEmpty():
            joined = written(components(links.unionByName(late), "a", "b"), "components")
    return p, reps, joined, sets


def join_sets(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join: its members and its links.

    Members are doc_id, e, n: one row for each row, with the hash of its set (null if empty) and the set's size. Links
    are a, b, a < b: each two different sets (by e) with 100 * intersection >= percent * union, once. Rows with equal e
    have equal sets and link too.
    """
    p, reps, joined, sets = _joined(two(docs, key, text), percent)
    return p.select("doc_id", "e", "n"), written(_links_within(joined, reps, sets, percent, True), "all-links")


def ngram_join(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, unless it isn't wanted, n_links: one row for each row.

    Two rows link when 100 * intersection >= percent * union of their sets; component_id is the smallest
    doc_id that links lead to, n_links the number of other rows that a row links with. Texts without words, and
    null ones, have an empty set and link with nothing. Rows with equal or null ids are rows of their own,
    with a null id only named where no other is. Other columns are ignored; an empty table gives no rows.
    """
    p, reps, joined, sets = _joined(two(docs, key, text), percent)
    ids = reps.select(F.col("e").alias("node"), "doc_id")
    least = joined.join(ids, "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    of = reps.select("e", "doc_id", "copies").join(joined.join(least, "root").select(F.col("node").alias("e"), "least"), "e", "left")
    links = []
    if counted:
        of = of.join(_links_within(joined, reps, sets, percent, False), "e", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
        links = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    of = written(of.select("e", F.coalesce("least", "doc_id").alias("component_id"), *(["n_links"] if counted else [])), "found")
    return p.select("doc_id", "e", "n").join(of, "e", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *links)
