"""Command logs folded into relations.

What has an algebra is folded by aggregates: a key's rows before its last reset don't count, increments
after it are summed, and the last operation on a member or field wins. Strings whose order matters go
through one native sequential fold for each key; anything else through the interpreter, see ``replay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.log.replay import in_order


def counters(log: DataFrame) -> DataFrame:
    """key, value of SET, INCRBY and DEL (seq, cmd, key, v): sums after the last reset."""
    reset = F.max(F.when(F.col("cmd").isin("SET", "DEL"), F.col("seq"))).over(Window.partitionBy("key"))
    rows = log.withColumn("reset", reset).filter("reset is null or seq >= reset")
    return rows.groupBy("key").agg(F.sum(F.when(F.col("cmd") != "DEL", F.col("v"))).alias("value")).filter("value is not null")


def members(log: DataFrame, add: str = "SADD") -> DataFrame:
    """key, member of SADD, SREM and DEL (seq, cmd, key, member): the last operation after the last DEL wins."""
    gone = log.filter("cmd = 'DEL'").groupBy("key").agg(F.max("seq").alias("d"))
    rows = log.filter("cmd <> 'DEL'").join(gone, "key", "left").filter("d is null or seq > d")
    return rows.groupBy("key", "member").agg(F.max_by("cmd", "seq").alias("cmd")).filter(F.col("cmd") == add).select("key", "member")


def fields(log: DataFrame) -> DataFrame:
    """key, field, value of HSET, HDEL and DEL (seq, cmd, key, field, v)."""
    gone = log.filter("cmd = 'DEL'").groupBy("key").agg(F.max("seq").alias("d"))
    rows = log.filter("cmd <> 'DEL'").join(gone, "key", "left").filter("d is null or seq > d")
    last = rows.groupBy("key", "field").agg(F.max_by(F.struct("cmd", "v"), "seq").alias("x"))
    return last.filter("x.cmd = 'HSET'").select("key", "field", F.col("x.v").alias("value"))


def scores(log: DataFrame) -> DataFrame:
    """key, member, score of ZADD, ZINCRBY, ZREM (seq, cmd, key, member, v): increments after the member's last reset."""
    reset = F.max(F.when(F.col("cmd").isin("ZADD", "ZREM"), F.col("seq"))).over(Window.partitionBy("key", "member"))
    rows = log.withColumn("reset", reset).filter("reset is null or seq >= reset")
    return rows.groupBy("key", "member").agg(F.sum(F.when(F.col("cmd") != "ZREM", F.col("v"))).alias("score")).filter("score is not null")


def strings(log: DataFrame) -> DataFrame:
    """key, value of SET, SETNX, APPEND, DEL (seq, cmd, key, value), folded in order without leaving the JVM."""
    step = F.struct("seq", "cmd", "value")
    g = log.groupBy("key").agg(F.array_sort(F.collect_list(step)).alias("ops"))
    merge = lambda s, o: (
        F.when(o.cmd == "SET", o.value).when(o.cmd == "SETNX", F.coalesce(s, o.value)).when(o.cmd == "APPEND", F.concat(F.coalesce(s, F.lit("")), o.value)).when(o.cmd == "DEL", F.lit(None).cast("string")).otherwise(s)
    )
    return g.select("key", F.aggregate("ops", F.lit(None).cast("string"), merge).alias("value")).filter("value is not null")


def general(log: DataFrame) -> DataFrame:
    """key, type, pos, value, errors after any commands on one key (seq, cmd, key, argv without it), run in order as a stream.

    Strings and lists come with their value, fields and members of other types in ``value`` likewise.
    """
    rows = log.select("seq", F.lit(0).alias("db"), "cmd", F.concat(F.array("key"), "argv").alias("argv"), F.lit(0).cast("long").alias("ts_ms"), "key")
    return in_order(rows, "key", ["seq"]).select("key", "type", "pos", F.coalesce("value", "field").alias("value"), "errors")
