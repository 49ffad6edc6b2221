"""Slots, node health and quorum: the computations a cluster needs, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.slots import key_slot


def key_slots(keys: DataFrame) -> DataFrame:
    return keys.select("key", key_slot(F.col("key")).alias("slot"))


def count_in_slots(keys: DataFrame) -> DataFrame:
    return key_slots(keys).groupBy("slot").agg(F.count("*").alias("n"))


def in_slot(keys: DataFrame, slot: int) -> DataFrame:
    return key_slots(keys).filter(F.col("slot") == slot).select("key")


def owners(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """key, slot, node: who owns each key, by slot ranges (node, first, last)."""
    by_slot = ranges.withColumn("slot", F.explode(F.sequence("first", "last"))).select("node", "slot")
    return key_slots(keys).join(by_slot, "slot", "left").select("key", "slot", "node")


def failed(reports: DataFrame, nodes: int) -> DataFrame:
    """node, reporters of nodes that a majority reports as failing."""
    return reports.groupBy("node").agg(F.count_distinct("reporter").alias("reporters")).filter(F.col("reporters") >= nodes // 2 + 1)


def silent(beats: DataFrame, now_ms: int, limit_ms: int = 30_000) -> DataFrame:
    """node, gap_ms of nodes not heard from for longer than the limit."""
    return beats.groupBy("node").agg((F.lit(now_ms) - F.max("at_ms")).alias("gap_ms")).filter(F.col("gap_ms") > limit_ms)


def objectively_down(reports: DataFrame, quorum: int) -> DataFrame:
    """node, reporters of nodes that at least ``quorum`` watchers report as down."""
    return reports.groupBy("node").agg(F.count_distinct("reporter").alias("reporters")).filter(F.col("reporters") >= quorum)


def elected(votes: DataFrame, voters: int) -> DataFrame:
    """epoch, candidate, votes of the candidates that a majority of the voters chose (epoch, voter, candidate, seq).

    A voter has one vote in an epoch, its first by ``seq`` (ties: the smallest candidate), so an epoch has one winner at most.
    """
    first = votes.groupBy("epoch", "voter").agg(F.min(F.struct("seq", "candidate"))["candidate"].alias("candidate"))
    return first.groupBy("epoch", "candidate").agg(F.count("*").alias("votes")).filter(F.col("votes") >= voters // 2 + 1)


def can_fail_over(watchers: DataFrame, quorum: int) -> DataFrame:
    """node, reachable, ok: whether the watchers that see a node (node, watcher, reachable) are a quorum and a majority (CKQUORUM)."""
    g = watchers.groupBy("node").agg(F.count_distinct("watcher").alias("known"), F.count_distinct(F.when(F.col("reachable"), F.col("watcher"))).alias("reachable"))
    return g.select("node", "reachable", ((F.col("reachable") >= quorum) & (F.col("reachable") * 2 > F.col("known"))).alias("ok"))
