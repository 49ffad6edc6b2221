"""Server commands that have a relational sense: literals, clock readings, settings, counts of the keyspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.schema import live


def ping(requests: DataFrame) -> DataFrame:
    """seq, reply: the message of each request, PONG where it has none (null)."""
    return requests.select("seq", F.coalesce("message", F.lit("PONG")).alias("reply"))


def echo(requests: DataFrame) -> DataFrame:
    """seq, reply: the message of each request; it needs one, so a null message is an error."""
    return requests.select("seq", F.col("message").alias("reply"), F.when(F.col("message").isNull(), "SYNTAX").alias("error"))


def clock(at_ms: Column) -> list[Column]:
    """seconds and micros of a time in milliseconds, as TIME gives them: micros of whole milliseconds."""
    return [F.floor(at_ms / 1000).cast("long").alias("seconds"), (F.pmod(at_ms, F.lit(1000)) * 1000).cast("long").alias("micros")]


def time(spark: SparkSession) -> DataFrame:
    """seconds, micros of now."""
    return spark.range(1).select(*clock(F.unix_millis(F.current_timestamp())))


def settings(table: DataFrame, asked: DataFrame) -> DataFrame:
    """seq, name, value of the settings (name, value) that each request's pattern asks for (CONFIG GET).

    A pattern without a star names one setting, in any case; one with stars is, the stars left out, the start of the names
    wanted. The table is small and bounded, so each request meets all of it.
    """
    low = F.lower("pattern")
    want = F.when(F.contains("p", F.lit("*")), F.startswith("name", F.replace("p", F.lit("*"), F.lit("")))).otherwise(F.col("name") == F.col("p"))
    return asked.select("seq", low.alias("p")).join(F.broadcast(table), want).select("seq", "name", "value")


def keyspace_info(keys: DataFrame, as_of_ms: int) -> DataFrame:
    """db, keys, expires: live keys of each database, and those that have an expiry (the keyspace section of INFO)."""
    return keys.filter(live(as_of_ms)).groupBy("db").agg(F.count("*").alias("keys"), F.count("expire_at_ms").alias("expires"))
