"""MULTI, EXEC and WATCH over a command log (seq, client_id, cmd, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batches(log: DataFrame) -> DataFrame:
    """client_id, watch_seq, exec_seq, commands of each EXEC: the queue since the client's last MULTI. DISCARD leaves none.

    Commands are numbered within each client by the marks before them, so clients are folded in parallel.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("client_id").orderBy("seq")
    ends = F.sum(F.when(F.col("cmd").isin("EXEC", "DISCARD"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    t = log.withColumn("batch", F.coalesce(ends, F.lit(0)))
    multi = F.max(F.when(F.col("cmd") == "MULTI", F.col("seq"))).over(Window.partitionBy("client_id", "batch"))
    t = t.withColumn("multi_seq", multi)
    return t.groupBy("client_id", "batch").agg(
        F.min(F.when(F.col("cmd") == "WATCH", F.col("seq"))).alias("watch_seq"),
        F.max("multi_seq").alias("multi_seq"),
        F.max(F.when(F.col("cmd") == "EXEC", F.col("seq"))).alias("exec_seq"),
        F.count_if((F.col("seq") > F.col("multi_seq")) & ~F.col("cmd").isin("EXEC", "DISCARD")).alias("commands"),
    ).filter("exec_seq is not null and multi_seq is not null").select("client_id", "watch_seq", "exec_seq", "commands")


def conflicts(watches: DataFrame, writes: DataFrame) -> DataFrame:
    """client_id, exec_seq of transactions to abort: a watched key (client_id, key, watch_seq, exec_seq) was written (seq, key) meanwhile.

    Any write counts, the watcher's own too. Of each key the watches and writes are put in order together, and a watch looks
    at the next write only, so a key's rows are sorted, never paired.
    """
    from pyspark.sql import Window

    both = watches.select("key", F.col("watch_seq").alias("at"), "client_id", "exec_seq", F.lit(None).cast("long").alias("write")).unionByName(
        writes.select("key", F.col("seq").alias("at"), F.lit(None).cast("long").alias("client_id"), F.lit(None).cast("long").alias("exec_seq"), F.col("seq").cast("long").alias("write"))
    )
    # A write at the very place of a watch comes before it. From the last row back, so that the frame grows.
    back = Window.partitionBy("key").orderBy(F.col("at").desc(), F.col("write").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    after = both.withColumn("next", F.min("write").over(back))
    return after.filter("exec_seq is not null and next > at and next < exec_seq").select("client_id", "exec_seq").distinct()


def apply(log: DataFrame) -> DataFrame:
    """What takes effect of a log (seq, client_id, cmd, key, ...): its columns and ``at``, the place where each command does.

    Commands outside of MULTI act where they stand. Those queued between MULTI and EXEC act at the EXEC, in their order,
    unless DISCARD came instead or a key that the client watched (WATCH, until EXEC, DISCARD or UNWATCH) was written between
    its WATCH and the EXEC. A write is any command outside of a queue but those of transactions; the queues of others count
    where they are executed, whether or not they are aborted themselves. A queue without an end does nothing.
    """
    from pyspark.sql import Window

    marks = ("MULTI", "EXEC", "DISCARD", "WATCH", "UNWATCH")
    by = Window.partitionBy("client_id").orderBy("seq")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(1, Window.unboundedFollowing)
    seq = lambda *names: F.when(F.col("cmd").isin(*names), F.col("seq"))
    t = log.withColumns({"opened": F.max(seq("MULTI")).over(before), "closed": F.max(seq("EXEC", "DISCARD")).over(before), "ends": F.min(F.when(F.col("cmd").isin("EXEC", "DISCARD"), F.struct("seq", "cmd"))).over(after), "forgot": F.min(seq("EXEC", "DISCARD", "UNWATCH")).over(after)})
    queued = F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("opened") > F.col("closed")))
    t = t.withColumn("queued", queued)
    acts = t.filter(~F.col("cmd").isin(*marks)).withColumn("at", F.when(~F.col("queued"), F.col("seq")).when(F.col("ends.cmd") == "EXEC", F.col("ends.seq"))).filter("at is not null")
    watches = t.filter((F.col("cmd") == "WATCH") & ~F.col("queued") & (F.col("ends.cmd") == "EXEC") & (F.col("forgot") == F.col("ends.seq")))
    gone = conflicts(watches.select("client_id", "key", F.col("seq").alias("watch_seq"), F.col("ends.seq").alias("exec_seq")), acts.select(F.col("at").alias("seq"), "key"))
    gone = gone.select("client_id", F.col("exec_seq").alias("at"), F.lit(True).alias("queued"))
    return acts.join(gone, ["client_id", "at", "queued"], "left_anti").select(*log.columns, "at")
