"""Substring deduplication over words by De Bruijn compaction.

Windows of 50 words are the edges of a De Bruijn graph. Edges that follow each other under one anchor lie on a path
of one row (see :mod:`keyloom.llm.repeats`); those that occur in a smaller document are named by their first
place, the source. Where paths of one anchor differ, their edges stand by themselves. Every occurrence of an
edge is joined with the one that follows it in its document; an edge whose occurrences are all followed by one and the
same edge, which in turn always comes after it, doesn't branch there, and such chains are compacted by joins
that double the distance to the chain's head. A chain is a span of its source. The words of each span are
digested at the source's coordinates, and a document's words are removed only where they give the same digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import repeats
from keyloom.llm.common import small_batches, written
from keyloom.llm.words import word_hashes

#: Words in a window and in an anchor.
SIZE, K = 50, 25
#: An edge: where it occurs first, and of how many windows it is.
EDGE = ("source_row", "source_start", "count")


def hash_words(texts: list[str]) -> Iterator[list]:
    return word_hashes([t.encode() for t in texts])


def repeated_edges(texts: DataFrame) -> DataFrame:
    """row, start, count, source_row, source_start: runs of windows (word numbers) that start in a smaller document too, with their first place."""
    found = repeats.find_paths(texts, hash_words, SIZE, K, within=False)
    whole = found.filter(F.col("kind") == repeats.REPEATED).select("row", "start", F.col("count").cast("long").alias("count"), "source_row", "source_start")
    # A source may itself repeat an earlier one.
    up = whole.select(F.col("row").alias("source_row"), F.col("start").alias("source_start"), "count", F.col("source_row").alias("up_row"), F.col("source_start").alias("up_start"))
    whole = whole.join(up, list(EDGE), "left").select("row", "start", "count", F.coalesce("up_row", "source_row").alias("source_row"), F.coalesce("up_start", "source_start").alias("source_start"))
    single = repeats.open_windows(texts, found, hash_words, SIZE).withColumn("count", F.lit(1).cast("long"))
    return written(whole.unionByName(single), "edges")


def chains(edges: DataFrame) -> DataFrame:
    """source_row, source_start, count, windows: the head edge of every chain of edges that doesn't branch, and the chain's number of windows."""
    edge = F.struct(*EDGE)
    sources = edges.select(F.col("source_row").alias("row"), F.col("source_start").alias("start"), *EDGE).distinct()
    all_ = written(edges.select("row", "start", edge.alias("e"), (F.col("start") + F.col("count")).alias("end")).unionByName(sources.select("row", "start", edge.alias("e"), (F.col("start") + F.col("count")).alias("end"))), "occurrences")
    pairs = written(all_.select("row", F.col("end").alias("at"), "e").join(all_.select("row", F.col("start").alias("at"), F.col("e").alias("next")), ["row", "at"], "left").select("e", "next"), "followed")
    out = pairs.groupBy("e").agg(F.count("*").alias("n"), F.count("next").alias("c"), F.min("next").alias("next"), F.max("next").alias("most"))
    into = pairs.filter("next is not null").groupBy("next").agg(F.count("*").alias("c"), F.min("e").alias("e"), F.max("e").alias("most"))
    out = written(out, "degrees")
    one = out.filter("n = c and next = most").select("e", "next")
    only = into.join(out.select(F.col("e").alias("next"), "n"), "next").filter("n = c and e = most").select("e", "next")
    # Each edge that goes on a chain, and an edge before it: the one just before, then 2, 4, ... before, until it is the head.
    back = written(one.join(only, ["e", "next"]).select(F.col("next").alias("e"), F.col("e").alias("head")), "links")
    while True:
        step = back.join(back.select(F.col("e").alias("head"), F.col("head").alias("up")), "head", "left")
        back = written(step.select("e", F.coalesce("up", "head").alias("head"), F.col("up").isNotNull().alias("moved")), "heads")
        if back.filter("moved").isEmpty():
            break
        back = back.drop("moved")
    members = back.groupBy("head").agg(F.max(F.col("e.source_start") + F.col("e.count")).alias("end"))
    heads = out.select("e").join(back.select("e"), "e", "left_anti").join(members.select(F.col("head").alias("e"), "end"), "e", "left")
    return heads.select("e.*", (F.coalesce("end", F.col("e.source_start") + F.col("e.count")) - F.col("e.source_start")).alias("windows"))


def digest(words: list[bytes], start: int, n: int) -> bytes:
    return blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


def repeated_spans(texts: DataFrame) -> DataFrame:
    """row, start, windows, source_row, source_start, digest: spans of windows that start in a smaller document too, and the digest of the source's words there."""
    edges = repeated_edges(texts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for row, t, asked in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("asked").to_pylist()):
                words = (t or "").encode().split()
                out += [(row, x["source_start"], x["count"], x["windows"], digest(words, x["source_start"], x["windows"] + SIZE - 1)) for x in asked]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (*[pa.int64()] * 4, pa.binary()))], [*EDGE, "windows", "digest"])

    asked = chains(edges).withColumnRenamed("source_row", "row")
    read_ = repeats.with_rows(texts.select("row", "text"), asked, "asked", ["source_start", "count", "windows"], "inner").mapInArrow(read, "source_row long, source_start long, count long, windows long, digest binary")
    return edges.join(read_, list(EDGE)).select("row", "start", "windows", "source_row", "source_start", "digest")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: every word covered by a window that starts in a smaller document is removed.

    Windows are judged on the input. Kept words are joined by one space; unchanged documents are rejoined
    too. Null texts have no words. Rows that share an id are documents of their own, none smaller than the other.
    Rows with a null id are kept whole. An empty table gives no rows. Other columns are ignored.
    """
    texts = repeats.held_texts(docs, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            n, removed, kept = [], [], []
            for t, rows in zip(b.column("text").to_pylist(), b.column("rows").to_pylist()):
                words = (t or "").encode().split()
                n.append(len(words))
                same = [{"start": r["start"], "count": r["windows"]} for r in rows or () if digest(words, r["start"], r["windows"] + SIZE - 1) == r["digest"]]
                if same:
                    gone = repeats.covered(len(words), same, SIZE)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return repeats.with_rows(texts, repeated_spans(texts), "rows", ["start", "windows", "digest"]).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
