"""Publish and subscribe over ``pubsub_sub`` (client_id, kind, name) and messages (seq, channel, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import glob_match, glob_regex


def subscribe(subs: DataFrame, new: DataFrame) -> DataFrame:
    return subs.unionByName(new).distinct()


def unsubscribe(subs: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the given rows; a row with a null name stands for all of that client's subscriptions of the kind."""
    named, all_ = gone.filter("name is not null"), gone.filter("name is null")
    return subs.join(named, ["client_id", "kind", "name"], "left_anti").join(all_.select("client_id", "kind"), ["client_id", "kind"], "left_anti")


def with_regex(spark, patterns: list[tuple[int, str]]) -> DataFrame:
    """client_id, name, regex, prefix of glob subscriptions: prefix is the literal text before the first special character."""
    import re

    rows = [(c, p, glob_regex(p), re.split(r"[*?\[]", p)[0]) for c, p in patterns]
    return spark.createDataFrame(rows, "client_id long, name string, regex string, prefix string")


def deliver_channels(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """seq, channel, client_id, name: an equi-join."""
    s = subs.filter("kind = 'channel'").select("client_id", "name")
    return messages.join(s, messages["channel"] == s["name"]).select("seq", "channel", "client_id", "name")


def deliver_patterns(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same through glob patterns: channels are matched once each, then messages join their channel's matches."""
    channels = messages.select("channel").distinct()
    hit = channels.join(patterns, F.col("channel").startswith(F.col("prefix")) & F.expr("channel rlike regex")).select("channel", "client_id", "name")
    return messages.join(hit, "channel").select("seq", "channel", "client_id", "name")


def channels(subs: DataFrame, pattern: str = "*") -> DataFrame:
    return subs.filter((F.col("kind") == "channel") & glob_match(F.col("name"), pattern)).select(F.col("name").alias("channel")).distinct()


def num_sub(subs: DataFrame, asked: DataFrame) -> DataFrame:
    """channel, n, zero where nobody listens."""
    s = subs.filter("kind = 'channel'").groupBy(F.col("name").alias("channel")).agg(F.count_distinct("client_id").alias("k"))
    return asked.select("channel").distinct().join(s, "channel", "left").select("channel", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def num_pat(subs: DataFrame) -> DataFrame:
    return subs.filter("kind = 'pattern'").agg(F.count("*").alias("n"))
