"""Set commands over ``kv_set`` (key, member)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AT = ["key", "member"]


def _of(s: DataFrame, key: str) -> DataFrame:
    return s.filter(F.col("key") == key).select("member")


def add(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.select(AT).unionByName(new.select(AT)).distinct()


def added(s: DataFrame, new: DataFrame) -> DataFrame:
    return new.select(AT).distinct().join(s.select(AT), AT, "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def remove(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.select(AT).join(gone.select(AT), AT, "left_anti")


def members(s: DataFrame, key: str) -> DataFrame:
    return _of(s, key)


def is_member(s: DataFrame, asked: DataFrame) -> DataFrame:
    """key, member, found (0 or 1) of SISMEMBER and SMISMEMBER."""
    return asked.select(AT).join(s.select(*AT, F.lit(1).alias("f")).distinct(), AT, "left").select(*AT, F.coalesce("f", F.lit(0)).cast("int").alias("found"))


def card(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("card"))


def inter(s: DataFrame, keys: list[str]) -> DataFrame:
    """One aggregation for any number of sets: members that all keys have."""
    want = len(set(keys))
    return s.filter(F.col("key").isin(*set(keys))).groupBy("member").agg(F.count_distinct("key").alias("n")).filter(F.col("n") == want).select("member")


def union(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.filter(F.col("key").isin(*keys)).select("member").distinct()


def diff(s: DataFrame, keys: list[str]) -> DataFrame:
    first, rest = keys[0], keys[1:]
    return _of(s, first).join(s.filter(F.col("key").isin(*rest)).select("member"), "member", "left_anti") if rest else _of(s, first)


def inter_card(s: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    out = inter(s, keys)
    return (out.limit(limit) if limit else out).agg(F.count("*").alias("card"))


def store(s: DataFrame, target: str, found: DataFrame) -> DataFrame:
    """The relation with ``found`` as the set at ``target``; an empty result leaves no key."""
    return s.filter(F.col("key") != target).select(AT).unionByName(found.select(F.lit(target).alias("key"), "member"))


def move(s: DataFrame, source: str, target: str, member: str) -> DataFrame:
    hit = (F.col("key") == source) & (F.col("member") == member)
    return s.select(F.when(hit, target).otherwise(F.col("key")).alias("key"), "member").distinct()


def random_members(s: DataFrame, n: int, seed: int) -> DataFrame:
    """SRANDMEMBER: up to ``n`` members of each key by seeded hash."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "member")), "member"))
    return s.withColumn("rn", rn).filter(F.col("rn") <= n).select(AT)


def pop(s: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """SPOP: (popped, rest)."""
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "member")), "member")))
    return r.filter(F.col("rn") <= n).select(AT), r.filter(F.col("rn") > n).select(AT)


def page(s: DataFrame, after: str | None, n: int) -> DataFrame:
    """SSCAN by keyset."""
    rows = s if after is None else s.filter(F.col("member") > after)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("member"))).filter(F.col("rn") <= n).select(AT)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
