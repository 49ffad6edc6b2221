"""String commands over ``kv_string`` (key, value, expire_at_ms): reads are queries, writes give the new relation.

Writes that set a value clear its expiry unless told to keep it. Requests are relations too, so one call serves many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import byte_overlay, byte_slice, float_text, integer
from keyloom.schema import live


def _none() -> Column:
    return F.lit(None).cast("long")


def get(kv: DataFrame, keys: DataFrame, as_of_ms: int) -> DataFrame:
    """ord, key, value in request order; null where missing or expired (GET, MGET). ``keys``: ord, key."""
    return keys.join(kv.filter(live(as_of_ms)).select("key", "value"), "key", "left").select("ord", "key", "value")


def set_(kv: DataFrame, new: DataFrame, as_of_ms: int, only: str | None = None, keep_ttl: bool = False) -> DataFrame:
    """The relation after SET of ``new`` (key, value, expire_at_ms); the last by ``ord`` wins if there is one.

    ``only``: "nx" sets only missing keys, "xx" only existing ones.
    """
    if only not in (None, "nx", "xx"):
        raise ValueError("only is nx, xx or None")
    old = kv.filter(live(as_of_ms))
    if "ord" in new.columns:
        new = new.groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.max_by("expire_at_ms", "ord").alias("expire_at_ms"))
    if only:
        new = new.join(old.select("key"), "key", "left_anti" if only == "nx" else "left_semi")
    if keep_ttl:
        new = new.drop("expire_at_ms").join(old.select("key", "expire_at_ms"), "key", "left")
    return old.join(new.select("key"), "key", "left_anti").select("key", "value", "expire_at_ms").unionByName(new.select("key", "value", "expire_at_ms"))


def set_if_none(kv: DataFrame, new: DataFrame, as_of_ms: int) -> DataFrame:
    """MSETNX: all of ``new`` or, if any of its keys exists, nothing."""
    clash = new.join(kv.filter(live(as_of_ms)).select("key"), "key", "left_semi").agg(F.count("*").alias("clashes"))
    ok = new.crossJoin(F.broadcast(clash)).filter("clashes = 0").drop("clashes")
    return kv.filter(live(as_of_ms)).select("key", "value", "expire_at_ms").unionByName(ok.select("key", "value", "expire_at_ms"))


def increment(kv: DataFrame, deltas: DataFrame, as_of_ms: int) -> DataFrame:
    """key, value (text), error of each key in ``deltas`` (key, delta) after INCR, DECR, INCRBY, DECRBY.

    A missing key counts from 0. A text that is no integer, or a sum beyond 64 bits, gives an error and no value.
    """
    d = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))
    j = d.join(kv.filter(live(as_of_ms)).select("key", "value"), "key", "left")
    base = F.when(F.col("value").isNull(), F.lit(0)).otherwise(integer(F.col("value")))
    total = base.cast("decimal(38,0)") + F.col("delta")
    fits = total.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return j.select(
        "key",
        F.when(fits, total.try_cast("long").cast("string")).alias("value"),
        F.when(base.isNull(), "value is not an integer or out of range").when(~fits, "increment or decrement would overflow").alias("error"),
    )


def increment_float(kv: DataFrame, deltas: DataFrame, as_of_ms: int) -> DataFrame:
    """key, number, value after INCRBYFLOAT; whole numbers are printed without a fraction."""
    j = deltas.groupBy("key").agg(F.sum("delta").alias("delta")).join(kv.filter(live(as_of_ms)).select("key", "value"), "key", "left")
    n = F.coalesce(F.col("value"), F.lit("0")).try_cast("double") + F.col("delta")
    return j.select("key", n.alias("number"), float_text(n).alias("value"))


def append(kv: DataFrame, tails: DataFrame, as_of_ms: int) -> DataFrame:
    """key, value, length after APPEND of ``tails`` (key, ord, tail), in order; the expiry is cleared."""
    t = tails.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tail"))), lambda x: x.tail), "").alias("tail"))
    j = t.join(kv.filter(live(as_of_ms)).select("key", "value"), "key", "left")
    v = F.concat(F.coalesce("value", F.lit("")), "tail")
    return j.select("key", v.alias("value"), F.octet_length(v).cast("long").alias("length"))


def length(kv: DataFrame, as_of_ms: int) -> DataFrame:
    """key, length in bytes (STRLEN)."""
    return kv.filter(live(as_of_ms)).select("key", F.octet_length("value").cast("long").alias("length"))


def get_range(kv: DataFrame, start: int, stop: int, as_of_ms: int) -> DataFrame:
    return kv.filter(live(as_of_ms)).select("key", byte_slice(F.col("value"), start, stop).alias("part"))


def set_range(kv: DataFrame, offset: int, new: str, as_of_ms: int) -> DataFrame:
    return kv.filter(live(as_of_ms)).select("key", byte_overlay(F.col("value"), offset, new).alias("value"))


def get_set(kv: DataFrame, new: DataFrame, as_of_ms: int) -> DataFrame:
    """key, old, value: GETSET."""
    return new.select("key", F.col("value").alias("new")).join(kv.filter(live(as_of_ms)).select("key", F.col("value").alias("old")), "key", "left").select("key", "old", F.col("new").alias("value"))


def get_delete(kv: DataFrame, keys: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """(key, value of the asked keys; the relation without them)."""
    rows = kv.filter(live(as_of_ms))
    return rows.join(keys.select("key"), "key", "left_semi").select("key", "value"), rows.join(keys.select("key"), "key", "left_anti")


def get_expire(kv: DataFrame, keys: DataFrame, as_of_ms: int, ttl_ms: int | None) -> DataFrame:
    """The relation after GETEX of ``keys``: a new time to live, or with None no expiry."""
    asked = keys.select("key", F.lit(True).alias("asked"))
    new = _none() if ttl_ms is None else F.lit(as_of_ms + ttl_ms)
    return kv.filter(live(as_of_ms)).join(asked, "key", "left").select("key", "value", F.when(F.col("asked"), new).otherwise(F.col("expire_at_ms")).alias("expire_at_ms"))
