"""Connected components by alternating stars, as joins over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import small_batches, written

#: Edges that a task contracts together.
TOGETHER = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node of a batch to the least node it reaches there: fewer edges, the same components."""
    for b in small_batches(batches, TOGETHER):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        cols = list(zip(*pairs)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours to the least: of each node the larger ones (large), or itself and the smaller ones."""
    if large:
        both = edges.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hooked = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return joined.select(F.inline(hooked)).filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the least node of its component) of every node that has an edge; loops and repeats don't matter.

    Batches of edges are contracted first; then large and small stars alternate until nothing changes, when every
    edge points to a root. Each round is written, so lineage stays short; groups are reduced by
    pre-aggregated minima, never gathered.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").mapInArrow(_contract, "u long, v long")
    e, before = written(e, "edges"), None
    while True:
        # A checksum of the edge set, summed before anything is sent.
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now.n:
            break
        before = now
        e = written(_star(_star(e, True), False), "stars")
    return e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))).distinct()
