"""Replication as queries over a command log and the offsets that replicas report; an offset is the log's ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def acknowledged(reports: DataFrame) -> DataFrame:
    """replica, offset: the last that each replica reported (REPLCONF ACK), by ``seq`` of the reports; null offsets report nothing."""
    return reports.filter("offset is not null").groupBy("replica").agg(F.max_by("offset", "seq").alias("offset"))


def wait(replicas: DataFrame, master_offset: int) -> DataFrame:
    """One row, ``acked``: replicas that have reached the master's offset (WAIT). What WAIT would wait for is the caller's choice."""
    return replicas.agg(F.count_if(F.col("offset") >= master_offset).alias("acked"))


def resync(asked: DataFrame, replid: str, first: int, last: int) -> DataFrame:
    """replica, reply, start: CONTINUE from ``offset`` where a replica (replica, replid, offset) follows this master and the kept
    log, ``first`` to ``last``, still reaches back to it, else FULLRESYNC from ``last`` (PSYNC).

    ``start`` is the offset after which the replica reads the log; a full resync loads a snapshot of ``last`` before.
    """
    goes_on: Column = F.col("replid").eqNullSafe(replid) & F.coalesce(F.col("offset").between(first, last), F.lit(False))
    return asked.select("replica", F.when(goes_on, "CONTINUE").otherwise("FULLRESYNC").alias("reply"), F.when(goes_on, F.col("offset")).otherwise(F.lit(last)).cast("long").alias("start"))


def tail(log: DataFrame, offset: int) -> DataFrame:
    """The commands after an offset (REPLICAOF): a filter that scans push down. `streaming.groups.replica` follows a live log."""
    return log.filter(F.col("seq") > offset)
