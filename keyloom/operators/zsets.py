"""Sorted-set commands over ``kv_zset`` (key, member, score). Order is always (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.text import first_last

COLS = ["key", "member", "score"]
AT = ["key", "member"]


def _asc() -> list[Column]:
    return [F.col("score").asc(), F.col("member").asc()]


def _desc() -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()]


def add(z: DataFrame, new: DataFrame, only: str | None = None, better: str | None = None, incr: bool = False) -> DataFrame:
    """The relation after ZADD of ``new`` (key, member, score). only: nx or xx; better: gt or lt; incr adds to the score.

    Arguments count in the order of ``ord``: of a member given twice the last score holds (nx: the first, gt and lt: the
    best, incr: the sum). Without ``ord`` a member should be given once; else its largest score holds.
    """
    old = z.select(*AT, F.col("score").alias("old"), F.lit(True).alias("there"))
    if incr:
        of = F.sum("score")
    elif better:
        of = F.max("score") if better == "gt" else F.min("score")
    elif "ord" in new.columns:
        of = F.min_by("score", "ord") if only == "nx" else F.max_by("score", "ord")
    else:
        of = F.max("score")
    n = new.groupBy(AT).agg(of.alias("new"), F.lit(True).alias("hit"))
    j = old.join(n, AT, "full_outer")
    there, hit = F.coalesce("there", F.lit(False)), F.coalesce("hit", F.lit(False))
    if only == "xx":
        j = j.filter(there)
    value = F.coalesce("old", F.lit(0.0)) + F.col("new") if incr else F.col("new")
    take = hit & (~there if only == "nx" else F.lit(True))
    if better:
        take = take & (~there | (value > F.col("old") if better == "gt" else value < F.col("old")))
    return j.select(*AT, F.when(take, value).otherwise(F.col("old")).alias("score")).filter("score is not null")


def card(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("card"))


def score(z: DataFrame, asked: DataFrame) -> DataFrame:
    """ord, key, member, score of ZSCORE and ZMSCORE; null where missing."""
    return asked.join(z.select(COLS), AT, "left").select("ord", *COLS)


def ranked(z: DataFrame, reverse: bool = False) -> DataFrame:
    """key, member, score, rank from 0."""
    return z.select(*COLS, (F.row_number().over(Window.partitionBy("key").orderBy(*(_desc() if reverse else _asc()))) - 1).cast("long").alias("rank"))


def rank(z: DataFrame, asked: DataFrame, reverse: bool = False) -> DataFrame:
    """Ranks of the asked members; only their sets are ranked."""
    return ranked(z.join(asked.select("key").distinct(), "key", "left_semi"), reverse).join(asked.select(AT), AT, "left_semi")


def top(z: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    """key, member, score, rank of the first ``n``: the raw row number is filtered, so partitions keep ``n`` before the shuffle."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy(*(_desc() if reverse else _asc())))
    return z.withColumn("rn", rn).filter(F.col("rn") <= n).select(*COLS, (F.col("rn") - 1).cast("long").alias("rank"))


def range_(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE by rank; indexes may count from the end."""
    if 0 <= start <= stop:
        return top(z, stop + 1, reverse).filter(F.col("rank") >= start)
    r = ranked(z, reverse).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    first, last = first_last(start, stop, F.col("n"))
    return r.filter((F.col("rank") >= first) & (F.col("rank") <= last)).drop("n")


def in_score(low: float, high: float, low_open: bool = False, high_open: bool = False) -> Column:
    s = F.col("score")
    return (s > low if low_open else s >= low) & (s < high if high_open else s <= high)


def range_by_score(z: DataFrame, low: float, high: float, low_open: bool = False, high_open: bool = False) -> DataFrame:
    return z.filter(in_score(low, high, low_open, high_open)).select(COLS)


def in_lex(low: str, high: str) -> Column:
    """Bounds as ``[a``, ``(a``, ``-`` or ``+``; members compare by their bytes."""
    m, out = F.col("member"), F.lit(True)
    for bound, ge in ((low, True), (high, False)):
        if bound in "-+":
            if (bound == "+") == ge:
                out = F.lit(False)
            continue
        if bound[0] not in "[(":
            raise ValueError("min or max not valid string range item")
        v = bound[1:]
        out = out & ((m >= v if bound[0] == "[" else m > v) if ge else (m <= v if bound[0] == "[" else m < v))
    return out


def range_by_lex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.filter(in_lex(low, high)).select(COLS)


def count(z: DataFrame, low: float, high: float, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """key, n; sets with none in range are 0."""
    return z.groupBy("key").agg(F.count_if(in_score(low, high, low_open, high_open)).alias("n"))


def remove(z: DataFrame, gone: DataFrame) -> DataFrame:
    return z.select(COLS).join(gone.select(AT), AT, "left_anti")


def remove_by_score(z: DataFrame, low: float, high: float) -> DataFrame:
    return z.filter(~in_score(low, high)).select(COLS)


def remove_by_lex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.filter(~in_lex(low, high)).select(COLS)


def remove_by_rank(z: DataFrame, start: int, stop: int) -> DataFrame:
    r = ranked(z).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    first, last = first_last(start, stop, F.col("n"))
    return r.filter((F.col("rank") < first) | (F.col("rank") > last)).select(COLS)


def pop(z: DataFrame, n: int, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest) of ZPOPMIN or ZPOPMAX: min(n, size) members."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy(*(_desc() if largest else _asc())))
    return top(z, n, largest).select(COLS), z.withColumn("rn", rn).filter(F.col("rn") > n).select(COLS)


def pop_first(z: DataFrame, keys: DataFrame, n: int, largest: bool = False) -> DataFrame:
    """ZMPOP: popped from the first non-empty set of ``keys`` (ord, key)."""
    first = z.join(keys, "key").groupBy().agg(F.min_by("key", "ord").alias("key"))
    return top(z.join(F.broadcast(first), "key", "left_semi"), n, largest)


def increment(z: DataFrame, deltas: DataFrame) -> DataFrame:
    return add(z, deltas, incr=True)


def combine(z: DataFrame, keys: list[str], every: bool, weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """member, score of ZUNION or, with ``every``, ZINTER; by default scores are added."""
    w = F.lit(1.0)
    for k, x in zip(keys, weights or []):
        w = F.when(F.col("key") == k, x).otherwise(w)
    how = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]
    g = z.filter(F.col("key").isin(*keys)).groupBy("member").agg(how(F.col("score") * w).alias("score"), F.count_distinct("key").alias("n"))
    return (g.filter(F.col("n") == len(set(keys))) if every else g).select("member", "score")


def difference(z: DataFrame, keys: list[str]) -> DataFrame:
    rest = z.filter(F.col("key").isin(*keys[1:])).select("member")
    return z.filter(F.col("key") == keys[0]).join(rest, "member", "left_anti").select("member", "score")


def store(z: DataFrame, target: str, found: DataFrame) -> DataFrame:
    return z.filter(F.col("key") != target).select(COLS).unionByName(found.select(F.lit(target).alias("key"), "member", "score"))


def random_members(z: DataFrame, n: int, seed: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "member")), "member"))
    return z.withColumn("rn", rn).filter(F.col("rn") <= n).select(COLS)


def page(z: DataFrame, after: tuple[float, str] | None, n: int) -> DataFrame:
    """ZSCAN by keyset: after a (score, member)."""
    rows = z if after is None else z.filter(F.struct("score", "member") > F.struct(F.lit(after[0]).alias("score"), F.lit(after[1]).alias("member")))
    return top(rows, n).select(COLS)
