"""Relations built from plain tables: the keyspace that the query catalogue works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Reads tables of a folder as relations; each reads only the columns it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def strings(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(F.concat(F.lit("cust:"), c).alias("key"), F.col("c_name").alias("value"), F.when(c % 4 == 0, F.lit(1704067200000) + c * 1000).alias("expire_at_ms"))

    def counters(self) -> DataFrame:
        """Balances in cents as text, some of them no integers."""
        c = F.col("c_custkey")
        return self.table("customer").select(F.concat(F.lit("bal:"), c).alias("key"), F.when(c % 10 == 0, "n/a").otherwise(F.round(F.col("c_acctbal") * 100).cast("long").cast("string")).alias("value"), F.lit(None).cast("long").alias("expire_at_ms"))

    def hashes(self) -> DataFrame:
        c = self.table("customer")
        e = F.when(F.col("c_custkey") % 3 == 0, F.lit(1704067200000) + F.col("c_custkey") * 1000)
        row = lambda f, v, x: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), x.cast("long").alias("field_expire_at_ms"))
        cells = F.array(row("name", F.col("c_name"), F.lit(None)), row("nation", F.col("c_nationkey"), e), row("cents", F.round(F.col("c_acctbal") * 100).cast("long"), F.lit(None)))
        return c.select(F.concat(F.lit("cust:"), F.col("c_custkey")).alias("key"), F.inline(cells))

    def lists(self) -> DataFrame:
        from pyspark.sql import Window

        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
        return self.table("lineitem").select(F.concat(F.lit("ord:"), F.col("l_orderkey")).alias("key"), rn.cast("long").alias("pos"), F.col("l_partkey").cast("string").alias("element"))

    def zsets(self) -> DataFrame:
        return self.table("customer").select(F.concat(F.lit("nat:"), F.col("c_nationkey")).alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))

    def sets(self) -> DataFrame:
        c = self.table("customer")
        m = F.col("c_custkey").cast("string").alias("member")
        return c.select(F.concat(F.lit("seg:"), F.col("c_mktsegment")).alias("key"), m).unionByName(c.select(F.concat(F.lit("nat:"), F.col("c_nationkey")).alias("key"), m))

    def stream(self) -> DataFrame:
        from pyspark.sql import Window

        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        e = self.table("events").select(F.concat(F.lit("ev:"), F.col("event_type")).alias("key"), ms.alias("id_ms"), "event_id", "user_id", "value")
        return e.withColumn("id_seq", (F.row_number().over(Window.partitionBy("key", "id_ms").orderBy("event_id")) - 1).cast("long"))

    def points(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(F.lit("geo").alias("key"), F.col("c_name").alias("member"), ((c * 37 % 36000) / F.lit(100.0) - 180.0).alias("lon"), ((c * 53 % 17000) / F.lit(100.0) - 85.0).alias("lat"))

    def keyspace(self) -> DataFrame:
        s = self.strings().select(F.lit(0).alias("db"), "key", F.lit("string").alias("type"), "expire_at_ms")
        o = self.table("orders").select(F.lit(0).alias("db"), F.concat(F.lit("ord:"), F.col("o_orderkey")).alias("key"), F.lit("list").alias("type"), F.lit(None).cast("long").alias("expire_at_ms"))
        n = self.table("nation").select(F.lit(1).alias("db"), F.concat(F.lit("nat:"), F.col("n_nationkey")).alias("key"), F.lit("zset").alias("type"), F.lit(None).cast("long").alias("expire_at_ms"))
        return s.unionByName(o).unionByName(n)

    def log(self) -> DataFrame:
        """A command log from events: client = user, key = event type and user, value in hundredths."""
        ops = F.element_at(F.array(F.lit("SET"), F.lit("INCRBY"), F.lit("INCRBY"), F.lit("DEL"), F.lit("INCRBY")), (F.col("event_id") % 5 + 1).cast("int"))
        e = self.table("events")
        return e.select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("user_id").alias("client_id"), F.lit(0).alias("db"), ops.alias("cmd"), F.concat(F.lit("u:"), F.col("user_id")).alias("key"), F.round(F.col("value") * 100).cast("long").alias("v"))
