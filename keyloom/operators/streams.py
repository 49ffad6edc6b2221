"""Stream commands over ``kv_stream`` (key, id_ms, id_seq, ...) and group relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ["id_ms", "id_seq"]


def _id() -> Column:
    return F.struct(*ID)


def _lit(x: tuple[int, int]) -> Column:
    return F.struct(F.lit(x[0]).cast("long").alias("id_ms"), F.lit(x[1]).cast("long").alias("id_seq"))


def add(entries: DataFrame) -> DataFrame:
    """Entries (key, id_ms, ord, ...) with id_seq: their order within the millisecond."""
    return entries.withColumn("id_seq", (F.row_number().over(Window.partitionBy("key", "id_ms").orderBy("ord")) - 1).cast("long"))


def rejected(entries: DataFrame) -> DataFrame:
    """Explicit ids that aren't above all before them (by ord): XADD refuses those."""
    before = F.max(_id()).over(Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return entries.withColumn("before", before).filter(_id() <= F.col("before")).drop("before")


def length(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("length"))


def range_(s: DataFrame, low: tuple[int, int], high: tuple[int, int], count: int | None = None, reverse: bool = False) -> DataFrame:
    """XRANGE, XREVRANGE: ids from low to high, both included; of each key the first ``count``. The milliseconds are a pushable filter."""
    rows = s.filter(F.col("id_ms").between(low[0], high[0])).filter((_id() >= _lit(low)) & (_id() <= _lit(high)))
    if count is None:
        return rows
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ID]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rn") <= count).drop("rn")


def read(s: DataFrame, after: DataFrame, count: int | None = None) -> DataFrame:
    """XREAD: entries beyond each key's id in ``after`` (key, last_ms, last_seq)."""
    rows = s.join(after, "key").filter(_id() > F.struct(F.col("last_ms").alias("id_ms"), F.col("last_seq").alias("id_seq"))).select(s.columns)
    if count is None:
        return rows
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*ID))).filter(F.col("rn") <= count).drop("rn")


def delete(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone.select("key", *ID), ["key", *ID], "left_anti")


def trim(s: DataFrame, most: int) -> DataFrame:
    """XTRIM MAXLEN: the newest ``most`` of each key."""
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*[F.col(c).desc() for c in ID]))).filter(F.col("rn") <= most).drop("rn")


def group_create(groups: DataFrame, new: DataFrame) -> DataFrame:
    """Groups (key, grp, last_ms, last_seq) with new ones added where there is none of the name."""
    return groups.unionByName(new.join(groups.select("key", "grp"), ["key", "grp"], "left_anti"))


def group_busy(groups: DataFrame, new: DataFrame) -> DataFrame:
    """key, grp, error: BUSYGROUP for each new group whose name is taken, which :func:`group_create` leaves as it is."""
    taken = groups.select("key", "grp").distinct().withColumn("error", F.lit("BUSYGROUP"))
    return new.select("key", "grp").join(taken, ["key", "grp"], "left")


def group_set_id(groups: DataFrame, key: str, grp: str, last: tuple[int, int]) -> DataFrame:
    hit = (F.col("key") == key) & (F.col("grp") == grp)
    return groups.withColumns({"last_ms": F.when(hit, last[0]).otherwise(F.col("last_ms")), "last_seq": F.when(hit, last[1]).otherwise(F.col("last_seq"))})


def group_destroy(groups: DataFrame, gone: DataFrame) -> DataFrame:
    return groups.join(gone.select("key", "grp"), ["key", "grp"], "left_anti")


def group_read(s: DataFrame, groups: DataFrame, consumer: str, now_ms: int, count: int | None = None, no_ack: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """XREADGROUP with ``>``: (delivered, pending rows that arise, groups with moved cursors)."""
    j = s.join(groups, "key").filter(_id() > F.struct(F.col("last_ms").alias("id_ms"), F.col("last_seq").alias("id_seq")))
    if count is not None:
        j = j.withColumn("rn", F.row_number().over(Window.partitionBy("key", "grp").orderBy(*ID))).filter(F.col("rn") <= count).drop("rn")
    top = j.groupBy("key", "grp").agg(F.max(_id()).alias("top"))
    moved = groups.join(top, ["key", "grp"], "left").select("key", "grp", F.coalesce("top.id_ms", "last_ms").alias("last_ms"), F.coalesce("top.id_seq", "last_seq").alias("last_seq"))
    pel = j.select("key", "grp", *ID, F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("long").alias("delivery_ms"), F.lit(1).alias("delivery_count"))
    return j.drop("last_ms", "last_seq"), pel.limit(0) if no_ack else pel, moved


def ack(pel: DataFrame, done: DataFrame) -> DataFrame:
    return pel.join(done.select("key", "grp", *ID), ["key", "grp", *ID], "left_anti")


def claim(pel: DataFrame, asked: DataFrame, consumer: str, min_idle_ms: int, now_ms: int) -> DataFrame:
    """The pending relation after XCLAIM of ``asked`` (key, grp, id): idle long enough goes over, with its count 1 again."""
    j = pel.join(asked.select("key", "grp", *ID, F.lit(True).alias("asked")), ["key", "grp", *ID], "left")
    hit = F.coalesce("asked", F.lit(False)) & (F.lit(now_ms) - F.col("delivery_ms") >= min_idle_ms)
    return j.select("key", "grp", *ID, F.when(hit, consumer).otherwise(F.col("consumer")).alias("consumer"), F.when(hit, now_ms).otherwise(F.col("delivery_ms")).cast("long").alias("delivery_ms"), F.when(hit, 1).otherwise(F.col("delivery_count")).alias("delivery_count"))


def auto_claim(pel: DataFrame, grp: str, consumer: str, min_idle_ms: int, now_ms: int, start: tuple[int, int] = (0, 0), count: int = 100) -> DataFrame:
    """XAUTOCLAIM: the first ``count`` idle entries of each key from ``start`` go over."""
    idle = pel.filter((F.col("grp") == grp) & (_id() >= _lit(start)) & (F.lit(now_ms) - F.col("delivery_ms") >= min_idle_ms))
    first = idle.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*ID))).filter(F.col("rn") <= count)
    return claim(pel, first, consumer, min_idle_ms, now_ms)


def pending_summary(pel: DataFrame) -> DataFrame:
    """key, grp, n, lowest and highest id, consumers."""
    return pel.groupBy("key", "grp").agg(F.count("*").alias("n"), F.min(_id()).alias("lo"), F.max(_id()).alias("hi"), F.count_distinct("consumer").alias("consumers")).select("key", "grp", "n", F.col("lo.id_ms").alias("lo_ms"), F.col("hi.id_ms").alias("hi_ms"), "consumers")


def pending_by_consumer(pel: DataFrame) -> DataFrame:
    return pel.groupBy("key", "grp", "consumer").agg(F.count("*").alias("n"))


def pending(pel: DataFrame, now_ms: int, min_idle_ms: int = 0, consumer: str | None = None, count: int | None = None) -> DataFrame:
    rows = pel.withColumn("idle_ms", F.lit(now_ms) - F.col("delivery_ms")).filter(F.col("idle_ms") >= min_idle_ms)
    rows = rows.filter(F.col("consumer") == consumer) if consumer else rows
    if count is not None:
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key", "grp").orderBy(*ID))).filter(F.col("rn") <= count)
    return rows.select("key", "grp", *ID, "consumer", "idle_ms", "delivery_count")


def info(s: DataFrame) -> DataFrame:
    """XINFO STREAM: key, length, first and last id."""
    return s.groupBy("key").agg(F.count("*").alias("length"), F.min(_id()).alias("lo"), F.max(_id()).alias("hi")).select("key", "length", F.col("lo.id_ms").alias("first_ms"), F.col("lo.id_seq").alias("first_seq"), F.col("hi.id_ms").alias("last_ms"), F.col("hi.id_seq").alias("last_seq"))


def tumbling(s: DataFrame, width_ms: int) -> DataFrame:
    """key, window_ms, n: entries in each window of ids."""
    return s.groupBy("key", (F.floor(F.col("id_ms") / width_ms) * width_ms).cast("long").alias("window_ms")).agg(F.count("*").alias("n"))


def sessions(s: DataFrame, gap_ms: int) -> DataFrame:
    """key, start_ms, end_ms, n: entries with no longer gap between them."""
    by = Window.partitionBy("key").orderBy(*ID)
    new = F.when(F.col("id_ms") - F.lag("id_ms").over(by) <= gap_ms, 0).otherwise(1)
    return s.withColumn("new", new).withColumn("part", F.sum("new").over(by)).groupBy("key", "part").agg(F.min("id_ms").alias("start_ms"), F.max("id_ms").alias("end_ms"), F.count("*").alias("n")).drop("part")
