"""Commands on keys of any type, over the ``keyspace`` relation (db, key, type, expire_at_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import glob_match, string_encoding
from keyloom.schema import live

COLS = ["db", "key", "type", "expire_at_ms"]


def _at(relation: DataFrame, asked: DataFrame) -> tuple[list[str], DataFrame]:
    """What keys are joined by: database and key, where the relation has databases; requests without one are for database 0."""
    if "db" not in relation.columns:
        return ["key"], asked
    return ["db", "key"], asked if "db" in asked.columns else asked.withColumn("db", F.lit(0))


def exists(ks: DataFrame, asked: DataFrame, as_of_ms: int) -> DataFrame:
    """found: how many of the asked keys are live, repeats counted (EXISTS, TOUCH)."""
    at, asked = _at(ks, asked)
    return asked.join(ks.filter(live(as_of_ms)).select(at), at, "left_semi").agg(F.count("*").alias("found"))


def type_(ks: DataFrame, asked: DataFrame, as_of_ms: int) -> DataFrame:
    """key (after db, if asked for), type."""
    out = [c for c in ("db", "key") if c in asked.columns]
    at, asked = _at(ks, asked)
    return asked.join(ks.filter(live(as_of_ms)).select(*at, "type"), at, "left").select(*out, F.coalesce("type", F.lit("none")).alias("type"))


def keys(ks: DataFrame, pattern: str, as_of_ms: int) -> DataFrame:
    return ks.filter(live(as_of_ms) & glob_match(F.col("key"), pattern)).select("key")


def scan(ks: DataFrame, after: str | None, n: int, as_of_ms: int, pattern: str = "*") -> DataFrame:
    """A page of ``n`` live keys after a key, in order, then those of them that match: a top-n, no offset."""
    rows = ks.filter(live(as_of_ms))
    rows = rows if after is None else rows.filter(F.col("key") > after)
    return rows.orderBy("key").limit(n).filter(glob_match(F.col("key"), pattern)).select("key")


def delete(rel: DataFrame, gone: DataFrame) -> DataFrame:
    """Any relation without the keys (DEL, UNLINK)."""
    at, gone = _at(rel, gone)
    return rel.join(gone.select(at), at, "left_anti")


def _is(rel: DataFrame, key: str, db: int):
    return (F.col("key") == key) & (F.col("db") == db if "db" in rel.columns else F.lit(True))


def rename(rel: DataFrame, source: str, target: str, only_new: bool = False, db: int = 0) -> DataFrame:
    """The relation after RENAME (RENAMENX: nothing changes if the target exists): value and expiry move."""
    there = rel.agg(F.bool_or(_is(rel, source, db)).alias("s"), F.bool_or(_is(rel, target, db)).alias("t"))
    act = F.coalesce("s", F.lit(False)) & (~F.coalesce("t", F.lit(False)) if only_new else F.lit(True))
    tagged = rel.crossJoin(F.broadcast(there.select(act.alias("act"))))
    kept = tagged.filter(~(F.col("act") & _is(rel, target, db) & F.lit(source != target)))
    return kept.withColumn("key", F.when(F.col("act") & _is(rel, source, db), target).otherwise(F.col("key"))).drop("act")


def copy(rel: DataFrame, source: str, target: str, replace: bool = False, db: int = 0) -> DataFrame:
    """The relation after COPY: values are copied, the expiry isn't."""
    there = rel.filter(_is(rel, target, db)).agg(F.count("*").alias("n"))
    new = rel.filter(_is(rel, source, db)).withColumn("key", F.lit(target))
    if "expire_at_ms" in rel.columns:
        new = new.withColumn("expire_at_ms", F.lit(None).cast("long"))
    if replace:
        return rel.filter(~_is(rel, target, db)).unionByName(new)
    return rel.unionByName(new.crossJoin(F.broadcast(there)).filter("n = 0").drop("n"))


def move(ks: DataFrame, asked: DataFrame, db: int) -> DataFrame:
    """The relation after MOVE of ``asked`` (db, key) to another database, where the key isn't there yet."""
    target = ks.filter(F.col("db") == db).select("key", F.lit(True).alias("taken"))
    a = asked.select("db", "key", F.lit(True).alias("asked"))
    j = ks.join(a, ["db", "key"], "left").join(target, "key", "left")
    return j.select(F.when(F.col("asked") & F.col("taken").isNull(), db).otherwise(F.col("db")).alias("db"), "key", "type", "expire_at_ms")


def expire(ks: DataFrame, asked: DataFrame, at_ms: int | None, as_of_ms: int) -> DataFrame:
    """The relation after EXPIRE, PEXPIRE, EXPIREAT, PEXPIREAT (an absolute time) or PERSIST (None)."""
    new = F.lit(at_ms).cast("long")
    at, asked = _at(ks, asked)
    return ks.filter(live(as_of_ms)).join(asked.select(*at, F.lit(True).alias("asked")).distinct(), at, "left").select("db", "key", "type", F.when(F.col("asked"), new).otherwise(F.col("expire_at_ms")).alias("expire_at_ms"))


def ttl(ks: DataFrame, asked: DataFrame, as_of_ms: int, unit_ms: int = 1000, absolute: bool = False) -> DataFrame:
    """key, ttl of TTL, PTTL (unit 1), EXPIRETIME and PEXPIRETIME (absolute): -2 missing, -1 no expiry."""
    out = [c for c in ("db", "key") if c in asked.columns]
    at, asked = _at(ks, asked)
    j = asked.select(at).join(ks.filter(live(as_of_ms)).select(*at, "expire_at_ms", F.lit(1).alias("there")), at, "left")
    e = F.col("expire_at_ms")
    return j.select(*out, F.when(F.col("there").isNull(), -2).when(e.isNull(), -1).otherwise(F.floor((e if absolute else e - as_of_ms) / unit_ms)).cast("long").alias("ttl"))


def db_size(ks: DataFrame, as_of_ms: int) -> DataFrame:
    """db, raw (with the expired), live."""
    return ks.groupBy("db").agg(F.count("*").alias("raw"), F.count_if(live(as_of_ms)).alias("live"))


def flush_db(rel: DataFrame, db: int) -> DataFrame:
    return rel.filter(F.col("db") != db)


def random_key(ks: DataFrame, as_of_ms: int, seed: int) -> DataFrame:
    return ks.filter(live(as_of_ms)).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "key")), "key").limit(1).select("key")


def compact(rel: DataFrame, as_of_ms: int) -> DataFrame:
    """The relation without expired rows: what an active sweep would leave."""
    return rel.filter(live(as_of_ms))


def encoding(rel: DataFrame, type_: str) -> DataFrame:
    """key, encoding: what OBJECT ENCODING reports, derived from sizes."""
    if type_ == "string":
        return rel.select("key", string_encoding(F.col("value")).alias("encoding"))
    names = {"list": ("element", "listpack", "quicklist", 128), "zset": ("member", "listpack", "skiplist", 128), "hash": ("value", "listpack", "hashtable", 127), "set": ("member", "listpack", "hashtable", 128)}
    column, small, large, most = names[type_]
    g = rel.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length(column)).alias("w"), F.bool_and(F.col(column).rlike("^-?[0-9]{1,18}$")).alias("ints"))
    out = F.when((F.col("n") <= most) & (F.col("w") <= 64), small).otherwise(large)
    if type_ == "set":
        out = F.when(F.col("ints") & (F.col("n") <= 512), "intset").when(F.col("ints"), large).otherwise(out)
    return g.select("key", out.alias("encoding"))


def memory_usage(rel: DataFrame, columns: list[str]) -> DataFrame:
    """key, bytes: a rough size, 64 and the bytes of the columns."""
    each = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return rel.groupBy("key").agg((F.lit(64) + F.sum(each)).cast("long").alias("bytes"))


def object_info(ks: DataFrame, as_of_ms: int) -> DataFrame:
    """db, key, refcount, idle, freq of live keys (OBJECT): relations share no values and keep no access times, so 1, 0 and 0."""
    return ks.filter(live(as_of_ms)).select("db", "key", F.lit(1).alias("refcount"), F.lit(0).alias("idle"), F.lit(0).alias("freq"))


def wrong_type(ks: DataFrame, requests: DataFrame, as_of_ms: int) -> DataFrame:
    """The requests (db, key, type, ...) and ``error``: WRONGTYPE where the live key holds another type than the command's."""
    held = ks.filter(live(as_of_ms)).select("db", "key", F.col("type").alias("held"))
    return requests.join(held, ["db", "key"], "left").withColumn("error", F.when(F.col("held") != F.col("type"), "WRONGTYPE")).drop("held")
