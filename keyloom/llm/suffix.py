"""Suffix-array deduplication of byte strings, with deep-shallow sorting.

Only suffixes that can repeat are sorted. Windows of 100 bytes are grouped into paths by anchors (see
:mod:`keyloom.llm.repeats`); whole paths that occur earlier are settled by their content (121 bits of two hashes).
The suffixes of all paths that remain are sorted: multikey quicksort with characters of eight bytes, where
each range is parted in three by a pivot and all ranges at once, to a shallow depth; then each range that
is still tied, having a long common prefix, is ordered by a blind trie, which keeps only branching depths and
characters and compares a new suffix with one leaf. Equal windows end in one leaf, and all but the first
of a leaf are repeats.

A task sorts the paths of some anchors at a time. The more paths an anchor has, the finer its paths are
split, by where the anchor lies in a window and by the bytes around it that such windows share, so that
a group's size stays bounded however often an anchor occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import repeats
from keyloom.llm.common import forget, partitions_for, small_batches, written
from keyloom.llm.words import U, _BYTE

#: Bytes in a window and in an anchor; depth of the quicksort.
SIZE, K, SHALLOW = 100, 32, 32
#: Paths that a task sorts together; paths of an anchor from which on each doubling splits them once more; finest split (a window by itself).
BLOCK, SPLIT, FINEST = 8192, 4096, 7


def hash_bytes(texts: list[str]) -> Iterator[np.ndarray]:
    for t in texts:
        yield _BYTE[np.frombuffer(t.encode(), np.uint8)]


class BlindTrie:
    """Strings by branching depths. A node is [depth, {byte: node}], a leaf a list of suffix numbers under None."""

    def __init__(self, text: bytes, places: list[int], length: int):
        self.text, self.places, self.length = text, places, length
        self.root: list | None = None

    def add(self, number: int) -> None:
        at, length, text = self.places[number], self.length, self.text
        s = text[at : at + length]
        node = self.root
        if node is None:
            self.root = [length, None, [number], s]
            return
        while node[1] is not None:  # blindly down: where no branch fits, any leaf will do
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[3]
        if other == s:
            node[2].append(number)
            return
        lo, hi = 0, length  # the first difference, by halving
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if s[:mid] == other[:mid]:
                lo = mid
            else:
                hi = mid
        depth = lo
        leaf = [length, None, [number], s]
        parent, node = None, self.root
        while node[1] is not None and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node[1] is not None and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        new = [depth, {other[depth]: node, s[depth]: leaf}]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def leaves(self) -> Iterator[list[int]]:
        """Numbers of equal suffixes, in the order of suffixes."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[1] is None:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def deep_shallow(text: bytes, places: np.ndarray, length: int = SIZE, shallow: int = SHALLOW, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``places`` by their first ``length`` bytes, and where each run of equal ones starts.

    Equal suffixes stay in the order of their numbers. The text must go on ``length`` bytes after each place.
    With ``group`` (ascending), only suffixes of one group are compared, and groups stay in order.
    """
    n = len(places)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(8), np.uint8), 8)
    shallow = min(shallow, length) // 8 * 8
    order, new, depth = np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64)
    new[0] = True
    if group is not None:
        new[1:] = group[1:] != group[:-1]

    def tied(at: np.ndarray) -> np.ndarray:
        """Those places of the order that lie in ranges of several."""
        edge = np.append(new, True)
        return at[~(edge[at] & edge[at + 1])]

    at = tied(order.copy())
    while len(at):
        rows = order[at]
        key = np.ascontiguousarray(words[places[rows] + depth[at]]).view(">u8").ravel().astype(U)
        first = np.flatnonzero(new[at])
        size = np.diff(np.append(first, len(at)))
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        # Three parts of each range, in each of which suffixes stay in the order they were.
        less, equal, greater = key < pivot, key == pivot, key > pivot
        to, begin = np.empty(len(at), np.int64), first
        for part in (less, equal, greater):
            before = np.cumsum(part) - part
            to[part] = (np.repeat(begin - before[first], size) + before)[part]
            count = np.add.reduceat(part.astype(np.int64), first)
            new[at[begin[count > 0]]] = True
            begin = begin + count
        order[at[to]] = rows
        depth[at[to]] = depth[at] + 8 * equal
        at = tied(at)
        at = at[depth[at] < shallow]
    edge = np.flatnonzero(np.append(new, True))
    spots = places.tolist()
    for a, b in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
        trie = BlindTrie(text, spots, length)
        for number in order[a:b].tolist():
            trie.add(number)
        at = a
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            new[at] = True
            at += len(leaf)
    return order, new


def split(part: bytes, anchor: int, level: int) -> Iterator[tuple[int, int, int]]:
    """The sub-paths of an open path: key, first window, number of windows.

    Windows are classed by the place of the anchor in them, in 2 ** level classes of neighbouring places; the
    key is a hash of the class and of the bytes around the anchor that all windows of the class contain.
    Equal windows hold their first anchor at one place and so have equal keys.
    """
    keys = (repeats.Sums(_BYTE[np.frombuffer(part, np.uint8)]).all(K) >> U(7)).astype(np.int64)
    found = np.flatnonzero(keys == anchor)
    start = np.arange(len(part) - SIZE + 1)
    at = found[np.searchsorted(found, start)]
    places, classes = SIZE - K + 1, 1 << level
    kind = (at - start) * classes // places
    cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (at[1:] != at[:-1])]))
    for i, stop in zip(cut.tolist(), [*cut[1:].tolist(), len(start)]):
        c, p = int(kind[i]), int(at[i])
        lo, hi = -(-c * places // classes), -(-(c + 1) * places // classes) - 1
        yield xxhash.xxh3_64_intdigest(part[p - lo : p - hi + SIZE], seed=c) - (1 << 63), i, stop - i


def again(held: list[tuple], key: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the paths (doc_id, row, start, bytes), in order and grouped by key: each window's path, and whether it repeats an earlier one."""
    text = b"".join(x[3] for x in held)
    size = np.array([len(x[3]) for x in held], np.int64)
    count = size - SIZE + 1
    row = np.repeat(np.arange(len(held)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    order, new = deep_shallow(text, np.repeat(np.cumsum(size) - size, count) + inside, group=np.array(key, np.int64)[row])
    out = np.zeros(len(row), bool)
    out[order[~new]] = True
    return row, out


def _compare(texts: DataFrame, found: DataFrame) -> DataFrame:
    """row, start, count: runs of windows of the open paths that start earlier too, by sorting suffixes."""
    block, finest = BLOCK, FINEST
    sent_as = "key long, doc_id long, row long, start long, count int, bytes binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in small_batches(batches):
            out, fine = [], []
            for doc, row, t, opens in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text", "opens"))):
                data = (t or "").encode()
                for r in opens:
                    start = r["start"]
                    part = data[start : start + r["count"] - 1 + SIZE]
                    if not r["level"]:
                        out.append((r["anchor"], doc, row, start, r["count"], part))
                    else:
                        fine += [(key, doc, row, start + i, n, part[i : i + n - 1 + SIZE]) for key, i, n in split(part, r["anchor"], r["level"])]
            seen = set()
            for x in sorted(fine):
                # What repeats whole inside a batch is settled, and needs no bytes.
                out.append((x[2], *x[1:5], None) if (x[0], x[5]) in seen else x)
                seen.add((x[0], x[5]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "doc_id", "row", "start", "count", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple[int, int, int, bytes]] = []  # doc_id, row, start, bytes
        keys: list[int] = []
        old = 0  # so many at the head have been given already

        def close() -> tuple[pa.RecordBatch, list[tuple]]:
            """Runs of repeated windows, and the paths that hold a window that is new."""
            row, gone = again(held, keys)
            begin = gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])
            at = np.flatnonzero(begin)
            length = np.bincount(np.cumsum(begin)[gone] - 1, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
            inside = at - np.searchsorted(row, row[at])
            mine = row[at] >= old
            rows, starts = np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64)
            found = pa.RecordBatch.from_arrays([pa.array(rows[row[at]][mine]), pa.array((starts[row[at]] + inside)[mine]), pa.array(length[mine].astype(np.int64))], ["row", "start", "count"])
            return found, [held[i] for i in np.unique(row[~gone]).tolist()]

        for b in batches:
            settled = b.column("bytes").is_null()
            yield pa.RecordBatch.from_arrays([b.column("row").filter(settled), b.column("start").filter(settled), b.column("count").cast(pa.int64()).filter(settled)], ["row", "start", "count"])
            for key, *x in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "row", "start", "bytes"))):
                if x[3] is None:
                    continue
                if len(held) - old >= block:
                    if keys[-1] != key:
                        yield close()[0]
                        held.clear(), keys.clear()
                        old = 0
                    elif keys[0] == key and len(held) - old >= 4 * block:
                        # One group only: what it holds that is new goes on, the rest is done.
                        batch, left = close()
                        yield batch
                        held[:], keys[:], old = left, [key] * len(left), len(left)
                held.append(tuple(x))
                keys.append(key)
        if held:
            yield close()[0]

    opens = found.filter(F.col("kind") == repeats.OPEN).select("row", "start", "count", "anchor")
    finer = F.least(F.lit(finest), F.ceil(F.log2(F.col("n") / SPLIT)).cast("int"))
    large = written(opens.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select("anchor", finer.alias("level")), "large")
    opens = opens.join(large, "anchor", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    sent = repeats.with_rows(texts.select("row", "doc_id", "text"), opens, "opens", ["start", "count", "anchor", "level"], "inner").mapInArrow(send, sent_as)
    return sent.repartition(partitions_for(texts), "key").sortWithinPartitions("key", "doc_id", "row", "start").mapInArrow(sort, "row long, start long, count long")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """row, start, count: runs of 100-byte windows (byte numbers) of row, doc_id, text that also start earlier."""
    found = repeats.find_paths(texts, hash_bytes, SIZE, K, within=True)
    whole = found.filter(F.col("kind") == repeats.REPEATED).select("row", "start", F.col("count").cast("long").alias("count"))
    return whole.unionByName(_compare(texts, found))


def dedup_suffixes(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), and the ``carried`` columns of ``docs``: one row for each row.

    Every byte under a window that also starts earlier is removed. Earlier is in a document with a
    smaller id, or before in the same one; windows are judged on the input. Rows that share an id are
    documents of their own, in the order of reading. Null texts are empty. Rows with a null id are kept
    whole. An empty table gives no rows. Columns that aren't carried are ignored.
    """
    texts = repeats.held_texts(docs, key, text, carried)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in small_batches(batches):
            out = []
            for t, rows in zip(b.column("text").to_pylist(), b.column("rows").to_pylist()):
                data = (t or "").encode()
                if not rows:
                    out.append((len(data), 0, 0, data))
                    continue
                gone = repeats.covered(len(data), rows, SIZE)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), *(b.column(f"carried_{c}") for c in carried)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(f"carried_{c}" for c in carried)],
            )

    numbers = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*numbers, T.StructField("kept", T.BinaryType()), *(T.StructField(f"carried_{c}", docs.schema[c].dataType) for c in carried)])
    out = repeats.with_rows(texts, repeated_windows(texts), "rows", ["start", "count"]).mapInArrow(cut, schema)
    return out.withColumnsRenamed({f"carried_{c}": c for c in carried})
