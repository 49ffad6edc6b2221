"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by K functions floor((a.x + b) / W) with Gaussian a. A query visits its own bucket
and then perturbed ones in estimated success order: each function's hash may move by one to either side,
at a score that is the squared distance to that side's border, and sets of moves are taken by rising total
score. Candidates of all tables are merged and ranked by exact distance.

Every row is indexed. Only W and the number of probes are fitted, on a bounded sample of rows: the fewest
probes (a power of two) whose recall on the sample reaches the target. Buckets are joined in cells of
bounded size, the rows of a large bucket being dealt over several, so no task holds a whole one.

A query that finds fewer than k rows so is compared with all rows, exactly, in cells of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import written

#: Rows (and queries) of a bucket that meet in one cell.
CELL_ROWS, CELL_QUERIES = 8192, 1024


def valid(c: Column) -> Column:
    """No null, not zero, all components there and finite."""
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(c, lambda x: x != 0)


def moves(scores: np.ndarray, probes: int) -> list[list[int]]:
    """The first ``probes`` sets of moves by rising total score, the empty set first.

    ``scores`` holds 2K squared border distances: move i lowers function i, move K + i raises it. Sets
    that move a function both ways are passed over. Sets grow from the cheapest move by replacing the
    dearest with the next or adding the next, so each set is met once and in order.
    """
    order = np.argsort(scores, kind="stable").tolist()
    k, out, heap = len(scores) // 2, [[]], [(float(scores[order[0]]), (0,))]
    while heap and len(out) < probes:
        total, chosen = heappop(heap)
        picked = [order[i] for i in chosen]
        if len({p % k for p in picked}) == len(picked):
            out.append(picked)
        last = chosen[-1]
        if last + 1 < len(order):
            step = float(scores[order[last + 1]])
            heappush(heap, (total + step, (*chosen, last + 1)))
            heappush(heap, (total + step - float(scores[order[last]]), (*chosen[:-1], last + 1)))
    return out


class Index:
    """The hash functions of all tables and the number of probes."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, seed: int):
        random = np.random.default_rng(seed)
        self.a = random.standard_normal((dim, tables * functions))
        self.b = random.uniform(0, width, tables * functions)
        self.tables, self.functions, self.width, self.probes = tables, functions, width, probes
        self.mix = random.integers(1, 1 << 62, (tables, functions), dtype=np.int64) | 1

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions in their cells (0 to 1): arrays of row, table, function."""
        with np.errstate(over="ignore", invalid="ignore"):
            p = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.functions)
            p = np.clip(np.nan_to_num(p), -(2.0**52), 2.0**52)  # what lies beyond meets in the last bucket
        h = np.floor(p)
        return h.astype(np.int64), p - h

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket keys; the table is part of the key."""
        with np.errstate(over="ignore"):
            return (hashes * self.mix).sum(axis=-1) + np.arange(self.tables)

    def probed(self, x: np.ndarray, flat: bool = True) -> list:
        """For each query the distinct keys of the buckets to visit, or else those of each table in order."""
        hashes, place = self.places(x)
        out = []
        with np.errstate(over="ignore"):
            for own, h, p in zip(self.keys(hashes), hashes, place):
                keys = []
                for t in range(self.tables):
                    step = np.concatenate([-self.mix[t], self.mix[t]])
                    scores = np.concatenate([p[t] ** 2, (1 - p[t]) ** 2])
                    keys.append(np.array([own[t] + step[m].sum() for m in moves(scores, self.probes)], np.int64))
                out.append(np.unique(np.concatenate(keys)) if flat else keys)
        return out


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest rows but its own id, of rows with one id the nearest, by exact distance then id: (query, row numbers, distances)."""
    by = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], ids[by][1:] != ids[by][:-1]])) if len(ids) else by
    single = len(first) == len(ids)
    if not len(ids):
        return
    # Squares about a middle row; what rounding can add to or take from them bounds which rows can be among the k nearest.
    with np.errstate(over="ignore", invalid="ignore"):
        middle = x[len(x) // 2]
        u, w = q - middle, x - middle
        uu, ww = (u * u).sum(1)[:, None], (w * w).sum(1)[None]
        rough = uu + ww - 2 * (u @ w.T)
        slack = 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (uu + ww)
        slack += 8 * np.finfo(np.float64).eps * (np.abs(middle) ** 2).sum()
    low, high = np.where(np.isfinite(rough), rough - slack, 0), np.where(np.isfinite(rough), rough + slack, np.inf)
    low[own[:, None] == ids[None]] = high[own[:, None] == ids[None]] = np.inf
    for i in range(len(q)):
        near = np.flatnonzero(own[i] != ids)
        if len(first) > k:
            limit = np.partition(high[i] if single else np.minimum.reduceat(high[i][by], first), k - 1)[k - 1]
            near = near[low[i][near] <= limit]
        d = distances(q[i], x[near])
        best = np.lexsort((ids[near], d))
        if not single:
            best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
        best = best[:k]
        yield i, near[best], d[best]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances; components whose squares overflow or vanish are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        apart = x - q
        d = np.sqrt((apart * apart).sum(1))
        far = ~((d > 1e-150) & (d < 1e150)) & (apart != 0).any(1)
        if far.any():
            scale = np.abs(apart[far]).max(1)
            d[far] = scale * np.sqrt(((apart[far] / scale[:, None]) ** 2).sum(1))
    return d


def fit(sample: np.ndarray, k: int, tables: int = 4, functions: int = 5, target: float = 0.96, seed: int = 7) -> Index:
    """W from the sample's spread, and the fewest probes of a table (a power of two, at most all) that reach the target recall on it.

    ``share`` of the index is the part of the sample that a query is compared with.
    """
    dim = sample.shape[1] if len(sample) else 1
    if not len(sample):
        return Index(dim, tables, functions, 1.0, 1, seed)
    scale = float(np.abs(sample).max())
    spread = scale * float(np.sqrt((sample / scale).var(axis=0).sum()))
    index = Index(dim, tables, functions, max(1.8 * spread, 1e-300), 3**functions, seed)
    asked = np.arange(0, len(sample), max(1, len(sample) // 64))
    true = {i: near for i, near, _ in nearest(sample[asked], sample, np.arange(len(sample)), asked, k) if len(near)}
    held = index.keys(index.places(sample)[0])
    at = np.full((len(asked), len(sample)), index.probes)  # how many probes it takes to meet each row
    for i, keys in enumerate(index.probed(sample[asked], flat=False)):
        for t in range(tables):
            order = np.argsort(keys[t], kind="stable")
            found = order[np.minimum(np.searchsorted(keys[t], held[:, t], sorter=order), len(order) - 1)]
            at[i] = np.where(keys[t][found] == held[:, t], np.minimum(at[i], found), at[i])
    index.probes = 1
    while index.probes < 3**functions and true and np.mean([(at[i][near] < index.probes).mean() for i, near in true.items()]) < target:
        index.probes *= 2
    index.share = float((at < index.probes).mean())
    return index


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", sample_rows: int = 2048, target: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by Euclidean distance.

    A row is no candidate of a query with its id. Ties go to the smaller vec_id; repeated ids count once,
    with their nearest vector. Vectors that are null, zero or hold null or non-finite components, or that
    have another dimension than most of the sample, take no part, nor do null ids. At most ``sample_rows``
    rows, the first by a hash of their id, fit the index; recall on them reaches ``target``. A query whose
    buckets hold fewer than k rows gets the k nearest of all rows; fewer are returned only where there are
    fewer candidates. Other columns are ignored; empty inputs give no rows.
    """
    spark = vectors.sparkSession

    def own(df: DataFrame) -> DataFrame:
        return df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v")))

    base, asked = own(vectors), own(queries)
    rows = [r.v for r in base.select("v", "id").orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()]
    dims = [len(v) for v in rows]
    dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 1
    index = fit(np.array([v for v in rows if len(v) == dim]).reshape(-1, dim), k, target=target)
    base, asked = base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)

    def matrix(b: pa.RecordBatch | pa.Table) -> np.ndarray:
        c = b.column("v")
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return np.asarray(c.flatten()).reshape(-1, dim).astype(np.float64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = index.keys(index.places(matrix(b))[0])
            for t in range(index.tables):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), b.column("id"), b.column("v")], ["bucket", "id", "v"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = index.probed(matrix(b))
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.array([], np.int64)), b.column("id").take(pa.array(at)), b.column("v").take(pa.array(at))], ["bucket", "id", "v"])

    schema = "bucket long, id long, v array<double>"
    buckets = written(base.mapInArrow(hashed, schema), "ann-rows")
    probes = written(asked.mapInArrow(probed, schema), "ann-probes")
    grid = buckets.groupBy("bucket").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("rs")).join(probes.groupBy("bucket").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("qs")), "bucket")
    left = buckets.join(grid, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("rs")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "id", "v")
    right = probes.join(grid, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("qs")).cast("int").alias("q"), "id", "v")

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and asked.num_rows:
            x, ids, q, own = matrix(rows), np.asarray(rows["id"]), matrix(asked), np.asarray(asked["id"])
            for a in range(0, len(q), 128):
                for i, near, d in nearest(q[a : a + 128], x, ids, own[a : a + 128], k):
                    out.append((np.full(len(near), own[a + i]), ids[near], d))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.array([], np.int64)] * 2 + [np.array([], np.float64)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def compared(left: DataFrame, right: DataFrame, *at: str) -> DataFrame:
        found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(cell, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    from pyspark.sql import Window

    by = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(best: DataFrame) -> DataFrame:
        return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = written(ranked(compared(left, right, "bucket", "r", "q")), "ann-found")
    full = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(asked.join(full, "id", "left_anti"), "ann-short")
    n = short.count()
    if not n:
        return best
    # Rows and queries are dealt by id, so all rows with one id are in one cell with a query.
    rs, qs = (max(1, -(-c // size)) for c, size in ((base.count(), CELL_ROWS), (n, CELL_QUERIES)))
    left = base.select(F.pmod(F.xxhash64("id"), F.lit(rs)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("q"), "id", "v")
    right = short.select(F.explode(F.sequence(F.lit(0), F.lit(rs - 1))).alias("r"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(qs)).cast("int").alias("q"), "id", "v")
    return best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(ranked(compared(left, right, "r", "q")))
