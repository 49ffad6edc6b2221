"""List commands over ``kv_list`` (key, pos, element). Positions may be sparse; reads make them dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.text import first_last


def dense(lists: DataFrame) -> DataFrame:
    """key, i (from 0), n, element."""
    by = Window.partitionBy("key")
    return lists.select("key", (F.row_number().over(by.orderBy("pos")) - 1).cast("long").alias("i"), F.count("*").over(by).alias("n"), "element")


def length(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("length"))


def range_(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """key, i, element of LRANGE; indexes may count from the end."""
    first, last = first_last(start, stop, F.col("n"))
    return dense(lists).filter((F.col("i") >= first) & (F.col("i") <= last)).select("key", "i", "element")


def index(lists: DataFrame, i: int) -> DataFrame:
    """key, element at an index; keys where it is out of range give no row."""
    return dense(lists).filter(F.col("i") == (F.lit(i) if i >= 0 else F.col("n") + i)).select("key", "element")


def push(lists: DataFrame, new: DataFrame, left: bool, must_exist: bool = False) -> DataFrame:
    """The relation after LPUSH or RPUSH of ``new`` (key, ord, element), one after another."""
    ends = lists.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    n = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    placed = new.withColumn("n", n).join(ends, "key", "inner" if must_exist else "left")
    pos = F.coalesce("lo", F.lit(0)) - F.col("n") if left else F.coalesce("hi", F.lit(-1)) + F.col("n")
    return lists.select("key", "pos", "element").unionByName(placed.select("key", pos.cast("long").alias("pos"), "element"))


def pop(lists: DataFrame, n: int, left: bool) -> tuple[DataFrame, DataFrame]:
    """(popped: key, ord, element; the rest: key, pos, element) of LPOP or RPOP of ``n``."""
    order = F.col("pos").asc() if left else F.col("pos").desc()
    r = lists.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(order)))
    return r.filter(F.col("rn") <= n).select("key", F.col("rn").cast("long").alias("ord"), "element"), r.filter(F.col("rn") > n).select("key", "pos", "element")


def set_at(lists: DataFrame, i: int, element: str) -> DataFrame:
    """key, i, element after LSET; lists that are too short stay as they are."""
    hit = F.col("i") == (F.lit(i) if i >= 0 else F.col("n") + i)
    return dense(lists).select("key", "i", F.when(hit, element).otherwise(F.col("element")).alias("element"))


def insert(lists: DataFrame, pivot: str, element: str, before: bool) -> DataFrame:
    """key, i, element after LINSERT at the first pivot; lists without it stay as they are."""
    d = dense(lists)
    at = d.filter(F.col("element") == pivot).groupBy("key").agg((F.min("i") * 2 + (-1 if before else 1)).alias("at"))
    rows = d.select("key", (F.col("i") * 2).alias("pos"), "element").unionByName(at.select("key", F.col("at").alias("pos"), F.lit(element).alias("element")))
    return dense(rows).select("key", "i", "element")


def remove(lists: DataFrame, count: int, element: str) -> DataFrame:
    """The relation after LREM: the first (or from the end) ``count`` equal elements go, all if 0."""
    if count == 0:
        return lists.filter(~F.col("element").eqNullSafe(F.lit(element))).select("key", "pos", "element")
    order = F.col("pos").asc() if count > 0 else F.col("pos").desc()
    rn = F.row_number().over(Window.partitionBy("key", "element").orderBy(order))
    return lists.withColumn("rn", rn).filter((F.col("element") != element) | (F.col("rn") > abs(count))).select("key", "pos", "element")


def move(lists: DataFrame, pairs: DataFrame, from_left: bool, to_left: bool) -> DataFrame:
    """The relation after LMOVE for each of ``pairs`` (source, target), which share no key; equal ones rotate."""
    popped, _ = pop(lists.join(pairs.select(F.col("source").alias("key")), "key", "left_semi"), 1, from_left)
    moved = popped.join(pairs, popped["key"] == pairs["source"]).select(F.col("target").alias("key"), "ord", "element")
    order = F.col("pos").asc() if from_left else F.col("pos").desc()
    first = lists.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(order))).join(pairs.select(F.col("source").alias("key"), F.lit(1).alias("s")), "key", "left")
    rest = first.filter("s is null or rn > 1").select("key", "pos", "element")
    return push(rest, moved, to_left)


def pop_first(lists: DataFrame, keys: DataFrame, n: int, left: bool) -> DataFrame:
    """LMPOP: key, ord, element popped from the first non-empty list of ``keys`` (ord, key)."""
    first = lists.join(keys, "key").groupBy().agg(F.min_by("key", "ord").alias("key"))
    return pop(lists.join(F.broadcast(first), "key", "left_semi"), n, left)[0]


def position(lists: DataFrame, element: str, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """LPOS: key, i of matches from the ``rank``-th on (negative: from the end); count 0 gives all; maxlen bounds comparisons."""
    if rank == 0:
        raise ValueError("rank can't be zero")
    d = dense(lists)
    if maxlen:
        d = d.filter(F.col("i") < maxlen) if rank > 0 else d.filter(F.col("i") >= F.col("n") - maxlen)
    order = F.col("i").asc() if rank > 0 else F.col("i").desc()
    d = d.filter(F.col("element") == element).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(order)))
    d = d.filter(F.col("r") >= abs(rank))
    return (d.filter(F.col("r") < abs(rank) + count) if count else d).select("key", "i")
