"""Hash commands over ``kv_hash`` (key, field, value, field_expire_at_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import float_text, integer
from keyloom.schema import live

COLS = ["key", "field", "value", "field_expire_at_ms"]


def get(h: DataFrame, field: str) -> DataFrame:
    return h.filter(F.col("field") == field).select("key", "value")


def multi_get(h: DataFrame, asked: DataFrame) -> DataFrame:
    """ord, key, field, value in request order. ``asked``: ord, key, field."""
    return asked.join(h.select("key", "field", "value"), ["key", "field"], "left").select("ord", "key", "field", "value")


def set_(h: DataFrame, new: DataFrame, only_new: bool = False) -> DataFrame:
    """The relation after HSET or HMSET (HSETNX: ``only_new``); a field's time to live stays.

    Of a field given twice the last value by ``ord`` holds (HSETNX: the first), without ``ord`` the greatest.
    """
    at = ["key", "field"]
    of = F.max("value") if "ord" not in new.columns else F.min_by("value", "ord") if only_new else F.max_by("value", "ord")
    new = new.groupBy(at).agg(of.alias("value"))
    if only_new:
        return h.select(COLS).unionByName(new.join(h.select(at), at, "left_anti").select("key", "field", "value", F.lit(None).cast("long").alias("field_expire_at_ms")))
    j = h.select(COLS).join(new.select("key", "field", F.col("value").alias("new"), F.lit(True).alias("hit")), at, "full_outer")
    return j.select("key", "field", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"), "field_expire_at_ms")


def added(h: DataFrame, new: DataFrame) -> DataFrame:
    """key, added: how many fields HSET would create."""
    return new.select("key", "field").distinct().join(h.select("key", "field"), ["key", "field"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def delete(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone.select("key", "field"), ["key", "field"], "left_anti").select(COLS)


def exists(h: DataFrame, asked: DataFrame) -> DataFrame:
    """key, field, found (0 or 1)."""
    return asked.select("key", "field").join(h.select("key", "field", F.lit(1).alias("f")), ["key", "field"], "left").select("key", "field", F.coalesce("f", F.lit(0)).cast("int").alias("found"))


def length(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("length"))


def fields(h: DataFrame) -> DataFrame:
    return h.select("key", "field")


def values(h: DataFrame) -> DataFrame:
    return h.select("key", "value")


def all_(h: DataFrame) -> DataFrame:
    return h.select("key", "field", "value")


def as_map(h: DataFrame) -> DataFrame:
    """key, fields: each hash as one map."""
    return h.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def increment(h: DataFrame, deltas: DataFrame) -> DataFrame:
    """key, field, number, error after HINCRBY; a value that is no integer, or a sum beyond 64 bits, gives an error and no number."""
    d = deltas.groupBy("key", "field").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))
    j = d.join(h.select("key", "field", "value"), ["key", "field"], "left")
    base = F.when(F.col("value").isNull(), F.lit(0)).otherwise(integer(F.col("value")))
    total = base.cast("decimal(38,0)") + F.col("delta")
    fits = total.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    error = F.when(base.isNull(), "hash value is not an integer").when(~fits, "increment or decrement would overflow")
    return j.select("key", "field", F.when(fits, total.try_cast("long")).alias("number"), error.alias("error"))


def increment_float(h: DataFrame, deltas: DataFrame) -> DataFrame:
    j = deltas.join(h.select("key", "field", "value"), ["key", "field"], "left")
    n = F.coalesce(F.col("value"), F.lit("0")).try_cast("double") + F.col("delta")
    return j.select("key", "field", n.alias("number"), float_text(n).alias("value"))


def page(h: DataFrame, after: str | None, n: int) -> DataFrame:
    """HSCAN by keyset: of each key the next ``n`` fields after one; no offset is ever skipped over."""
    from pyspark.sql import Window

    rows = h if after is None else h.filter(F.col("field") > after)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("field"))).filter(F.col("rn") <= n).select("key", "field", "value")


def random_fields(h: DataFrame, n: int, seed: int) -> DataFrame:
    """HRANDFIELD: up to ``n`` fields of each key, or with negative ``n`` that many with repeats."""
    from pyspark.sql import Window

    if n >= 0:
        rn = F.row_number().over(Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "field")), "field"))
        return h.withColumn("rn", rn).filter(F.col("rn") <= n).select("key", "field", "value")
    by = Window.partitionBy("key")
    d = h.withColumns({"i": F.row_number().over(by.orderBy("field")) - 1, "n": F.count("*").over(by)})
    draws = h.select("key").distinct().withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(-n))))
    picked = draws.join(d.groupBy("key").agg(F.max("n").alias("n")), "key").select("key", "d", F.pmod(F.xxhash64("key", "d", F.lit(seed)), F.col("n")).alias("i"))
    return picked.join(d.select("key", "i", "field", "value"), ["key", "i"]).select("key", "field", "value")


def _allowed(condition: str | None, old: Column, new: Column) -> Column:
    return {None: F.lit(True), "nx": old.isNull(), "xx": old.isNotNull(), "gt": old.isNull() | (new > old), "lt": old.isNull() | (new < old)}[condition]


def expire(h: DataFrame, asked: DataFrame, at_ms: int, as_of_ms: int, condition: str | None = None) -> DataFrame:
    """key, field, code of the HEXPIRE family: -2 no such field, 0 condition not met, 2 deleted (time is past), 1 set."""
    j = asked.select("key", "field").join(h.select("key", "field", "field_expire_at_ms", F.lit(1).alias("there")), ["key", "field"], "left")
    ok = _allowed(condition, F.col("field_expire_at_ms"), F.lit(at_ms))
    code = F.when(F.col("there").isNull(), -2).when(~ok, 0).when(F.lit(at_ms <= as_of_ms), 2).otherwise(1)
    return j.select("key", "field", code.cast("int").alias("code"))


def expired(h: DataFrame, asked: DataFrame, at_ms: int, as_of_ms: int, condition: str | None = None) -> DataFrame:
    """The relation after it."""
    codes = expire(h, asked, at_ms, as_of_ms, condition)
    j = h.join(codes, ["key", "field"], "left").filter("code is null or code <> 2")
    return j.select("key", "field", "value", F.when(F.col("code") == 1, F.lit(at_ms)).otherwise(F.col("field_expire_at_ms")).alias("field_expire_at_ms"))


def ttl(h: DataFrame, asked: DataFrame, as_of_ms: int, unit_ms: int = 1000, absolute: bool = False) -> DataFrame:
    """key, field, ttl of HTTL, HPTTL (unit 1) and, absolute, HEXPIRETIME, HPEXPIRETIME: -2 missing or expired, -1 none."""
    j = asked.select("key", "field").join(h.select("key", "field", "field_expire_at_ms", F.lit(1).alias("there")), ["key", "field"], "left")
    e = F.col("field_expire_at_ms")
    left = e if absolute else e - as_of_ms
    return j.select("key", "field", F.when(F.col("there").isNull() | ~live(as_of_ms, "field_expire_at_ms"), -2).when(e.isNull(), -1).otherwise(F.floor(left / unit_ms)).cast("long").alias("ttl"))


def persist(h: DataFrame, asked: DataFrame) -> DataFrame:
    """key, field, code of HPERSIST: 1 dropped, -1 had none, -2 no such field."""
    j = asked.select("key", "field").join(h.select("key", "field", "field_expire_at_ms", F.lit(1).alias("there")), ["key", "field"], "left")
    return j.select("key", "field", F.when(F.col("there").isNull(), -2).when(F.col("field_expire_at_ms").isNull(), -1).otherwise(1).cast("int").alias("code"))
