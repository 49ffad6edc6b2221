"""Windows that start earlier too: the distributed part that substring and suffix deduplication share.

A document is a sequence of units (words or bytes) with 64-bit hashes. Every window of ``size`` units has
an anchor: the least hash among the ``k``-mers inside it, so equal windows have equal anchors. A run of
consecutive windows with one anchor is a path of windows that needs one row instead of dozens: its anchor,
the hash of its whole content, its document and place.

Texts are written once, in buckets of a row number, so that later steps bring their findings to the texts
instead of shuffling texts again. Paths meet by anchor: sorted by anchor, content and place they stream by, and
one whose content has passed before is repeated as a whole. Only where an anchor occurs with several
contents must windows be compared one by one; those paths are returned as open. Nothing is held but
the first path of the content that goes by and the paths that wait for a second content of their anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bucketed, forget, partitions_for, small_batches, written
from keyloom.llm.words import CHUNK, U, _tables, mix

#: Documents settled together before rows are sent.
TOGETHER = 2048
I64 = np.int64
#: Added to a path's number of windows, which is under it.
TIED = 128

Hasher = Callable[[list[str]], Iterator[np.ndarray]]


class Sums:
    """Hashes of any run of a sequence of at most 2 * CHUNK units, from running sums."""

    def __init__(self, units: np.ndarray):
        up, self.down = _tables()
        self.s = np.zeros(len(units) + 1, U)
        np.cumsum(units * up[: len(units)], out=self.s[1:])

    def all(self, n: int) -> np.ndarray:
        return mix((self.s[n:] - self.s[:-n]) * self.down[: len(self.s) - n])

    def at(self, start: np.ndarray, n: int) -> np.ndarray:
        return mix((self.s[start + n] - self.s[start]) * self.down[start])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every run of w, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def paths(units: np.ndarray, size: int, k: int, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, content, first window, number of windows of each path, in order.

    Ties inside a window are told apart by place; equal windows then may lie in different paths, but
    have the same anchor. Long sequences are cut; a path ends there. With ``within``, TIED is added to the
    number where a window holds its anchor twice: only there can a path repeat itself.
    """
    out = []
    for at in range(0, max(1, len(units) - size + 1), CHUNK):
        part = units[at : at + CHUNK + size - 1]
        if len(part) < size:
            break
        sums = Sums(part)
        keys = sums.all(k)
        keys = keys >> U(7) << U(7) | (np.arange(len(keys), dtype=U) & U(127))
        least = _least(keys, size - k + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        # A window has at most 127 places for its anchor, so runs can't be longer.
        count = np.diff(np.append(first, len(least)))
        content = mix(sums.at(first, size) * U(3) + mix(sums.at(first + count - 1, size) + count.astype(U)))
        if within:
            last = _least(keys ^ U(127), size - k + 1) ^ U(127)
            tied = np.logical_or.reduceat(last != least, first) if len(first) else first
            count = count + TIED * tied
        out.append((least[first] >> U(7), content, first + at, count))
    if not out:
        return tuple(np.zeros(0, t) for t in (U, U, I64, I64))
    return tuple(np.concatenate(c) for c in zip(*out))


SENT = "kind int, anchor long, content long, doc_id long, row long, start long, count int"
FOUND = "row long, start long, count int, anchor long, kind int, source_row long, source_start long"
#: Kinds of found paths: all windows repeat an earlier one; to compare window by window.
REPEATED, OPEN = 0, 1


def held_texts(docs: DataFrame, key: str, text: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, text and carried_... of every row, written in buckets of ``row``, a number of its own for each."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *[docs[c].alias(f"carried_{c}") for c in carried])
    return bucketed(own, "row", "texts")


def _batch(names: str, *columns) -> pa.RecordBatch:
    """A batch of a schema like SENT from arrays."""
    fields = [f.split() for f in names.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k == "int" else c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


def find_paths(texts: DataFrame, hasher: Hasher, size: int, k: int, within: bool) -> DataFrame:
    """Paths of row, doc_id, text that repeat an earlier one (with its place), and paths to compare further; see FOUND.

    ``within``: an earlier place may be in the same document; else it must be in one with a smaller
    doc_id. Rows with null ids take part in nothing. Rows that share an id are documents of their own in the
    order of their row numbers.
    """
    together = TOGETHER

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in small_batches(batches, together):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc, row, units in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), hasher([t or "" for t in b.column("text").to_pylist()])):
                if doc is None or len(units) < size:
                    continue
                a, c, s, n = paths(units, size, k, within)
                for col, x in zip(cols, (a.view(I64), c.view(I64), np.full(len(a), doc, I64), np.full(len(a), row, I64), s, n)):
                    col.append(x)
            if not cols[0]:
                continue
            a, c, d, r, s, n = (np.concatenate(x) for x in cols)
            o = np.lexsort((s, r, d, c, a))
            a, c, d, r, s, n = a[o], c[o], d[o], r[o], s[o], n[o]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            settled = ~first if within else d != d[lead]
            # Of a settled path the content column carries the earlier place's row, the anchor column its start.
            a, c = np.where(settled, s[lead], a), np.where(settled, r[lead], c)
            yield _batch(SENT, np.where(settled, REPEATED, OPEN), a, c, d, r, s, np.where(settled, n & (TIED - 1), n))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        # Of the anchor and content that go on: the place of the first path, whether the anchor has several contents, and its paths that wait.
        last: tuple[int, int, tuple[int, int, int], bool] | None = None
        waiting: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            kind, *cols = (np.asarray(b.column(x)) for x in ("kind", "anchor", "content", "doc_id", "row", "start", "count"))
            done = kind == REPEATED
            if done.any():
                a, c, _, r, s, n = (x[done] for x in cols)
                yield _batch(FOUND, r, s, n, np.zeros(len(r), I64), np.zeros(len(r)), c, a)
            a, c, d, r, s, n = (x[~done] for x in cols)
            if not len(a):
                continue
            goes_on = last is not None and a[0] == last[0]
            new_anchor = np.concatenate([[not goes_on], a[1:] != a[:-1]])
            new = new_anchor | np.concatenate([[not (goes_on and c[0] == last[1])], c[1:] != c[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            before = last[2] if last else (0, 0, 0)
            ld, lr, ls = (np.where(lead >= 0, x[lead], y) for x, y in zip((d, r, s), before))
            repeated = ~new if within else ~new & (d != ld)
            group = np.cumsum(new_anchor)
            contents = np.bincount(group, weights=new)
            if goes_on:
                contents[0] += 1 + last[3]
                if contents[0] > 1:
                    yield from (_batch(FOUND, *x) for x in waiting)
            if not goes_on or contents[0] > 1 or group[-1] > 0:
                waiting.clear()
            open_ = ~repeated & ((contents[group] > 1) | (n >= TIED))
            wait = ~repeated & ~open_ & (group == group[-1])
            n = n & (TIED - 1)
            if wait.any():
                waiting.append((r[wait], s[wait], n[wait], a[wait], np.full(int(wait.sum()), OPEN), r[wait], s[wait]))
            last = int(a[-1]), int(c[-1]), (int(ld[-1]), int(lr[-1]), int(ls[-1])), bool(contents[group[-1]] > 1)
            keep = repeated | open_
            yield _batch(FOUND, r[keep], s[keep], n[keep], a[keep], np.where(repeated, REPEATED, OPEN)[keep], lr[keep], ls[keep])

    sent = texts.select("row", "doc_id", "text").mapInArrow(send, SENT)
    # Settled paths go anywhere.
    sent = sent.repartition(partitions_for(texts), F.when(F.col("kind") == OPEN, F.col("anchor")).otherwise(F.col("row")))
    return written(sent.sortWithinPartitions("kind", "anchor", "content", "doc_id", "row", "start").mapInArrow(settle, FOUND), "paths")


def open_windows(texts: DataFrame, found: DataFrame, hasher: Hasher, size: int) -> DataFrame:
    """row, start, source_row, source_start of each window of the open paths that starts in a smaller document too.

    Two hashes must agree, the anchor and the window's; equal windows meet by a pre-aggregated minimum.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in small_batches(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            cols = (b.column("doc_id").to_pylist(), b.column("row").to_pylist(), hasher([t or "" for t in b.column("text").to_pylist()]), b.column("opens").to_pylist())
            for doc, row, units, rows in zip(*cols):
                for x in rows:
                    h = Sums(units[x["start"] : x["start"] + x["count"] + size - 1]).all(size)
                    for col, y in zip(out, (np.full(len(h), x["anchor"], I64), h.view(I64), np.full(len(h), doc, I64), np.full(len(h), row, I64), x["start"] + np.arange(len(h)))):
                        col.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor", "h", "doc_id", "row", "start"])

    opens = with_rows(texts.select("row", "doc_id", "text"), found.filter(F.col("kind") == OPEN), "opens", ["start", "count", "anchor"], "inner")
    w = written(opens.mapInArrow(explode, "anchor long, h long, doc_id long, row long, start long"), "windows")
    first = w.groupBy("anchor", "h").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.max("doc_id").alias("last")).filter("last > first.doc_id")
    return w.join(first, ["anchor", "h"]).filter("doc_id > first.doc_id").select("row", "start", F.col("first.row").alias("source_row"), F.col("first.start").alias("source_start"))


def with_rows(texts: DataFrame, rows: DataFrame, name: str, columns: list[str], how: str = "left") -> DataFrame:
    """Each text with its rows as an array of structs. Only what was found is shuffled; texts lie in buckets."""
    mine = rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias(name))
    return texts.join(mine.hint("shuffle_hash"), "row", how)


def covered(n: int, rows: list[dict] | None, size: int) -> np.ndarray:
    """Which of n units the windows of the rows (start, count) cover."""
    step = np.zeros(n + 1, np.int32)
    if rows:
        start = np.array([r["start"] for r in rows], I64)
        stop = np.array([r["start"] + r["count"] - 1 + size for r in rows], I64)
        np.add.at(step, start, 1)
        np.add.at(step, stop, -1)
    return np.cumsum(step[:-1]) > 0
