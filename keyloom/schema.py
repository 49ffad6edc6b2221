"""Keyspace relations: schemas, liveness, key types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations of typed values and their columns.
SCHEMAS = {
    "kv_string": "db int, key string, value string, expire_at_ms long",
    "kv_hash": "db int, key string, field string, value string, field_expire_at_ms long, expire_at_ms long",
    "kv_list": "db int, key string, pos long, element string, expire_at_ms long",
    "kv_set": "db int, key string, member string, expire_at_ms long",
    "kv_zset": "db int, key string, member string, score double, expire_at_ms long",
    "kv_stream": "db int, key string, id_ms long, id_seq long, fields map<string,string>",
    "stream_group": "db int, key string, grp string, last_ms long, last_seq long",
    "stream_pel": "db int, key string, grp string, id_ms long, id_seq long, consumer string, delivery_ms long, delivery_count int",
    "pubsub_sub": "client_id long, kind string, name string",
    "command_log": "seq long, ts_ms long, client_id long, db int, cmd string, argv array<string>",
}
TYPES = {"kv_string": "string", "kv_hash": "hash", "kv_list": "list", "kv_set": "set", "kv_zset": "zset", "kv_stream": "stream"}


def live(as_of_ms: int, column: str = "expire_at_ms") -> Column:
    """A row is live up to and including the millisecond it expires at."""
    return F.col(column).isNull() | (F.col(column) >= as_of_ms)


def visible(relation: DataFrame, as_of_ms: int) -> DataFrame:
    """What reads of a relation of any type see at a time: no row of an expired key, nor an expired field of a hash."""
    for c in ("expire_at_ms", "field_expire_at_ms"):
        if c in relation.columns:
            relation = relation.filter(live(as_of_ms, c))
    return relation


def keyspace(relations: dict[str, DataFrame]) -> DataFrame:
    """db, key, type, expire_at_ms: one row for each key of the relations."""
    parts = []
    for name, df in relations.items():
        cols = df.columns
        db = F.col("db") if "db" in cols else F.lit(0)
        expire = F.col("expire_at_ms") if "expire_at_ms" in cols else F.lit(None).cast("long")
        parts.append(df.select(db.alias("db"), "key", expire.alias("expire_at_ms")).groupBy("db", "key").agg(F.max("expire_at_ms").alias("expire_at_ms")).withColumn("type", F.lit(TYPES[name])))
    return reduce(DataFrame.unionByName, parts).select("db", "key", "type", "expire_at_ms")


def type_conflicts(relations: dict[str, DataFrame]) -> DataFrame:
    """Keys that hold values of several types: there must be none."""
    return keyspace(relations).groupBy("db", "key").agg(F.count("*").alias("types")).filter("types > 1")
