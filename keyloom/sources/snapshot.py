"""Snapshots: one Parquet table for each relation, by database, clustered by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.schema import SCHEMAS, live


def save(relations: dict[str, DataFrame], path: str, as_of_ms: int | None = None) -> None:
    """Write relations; with a time, expired rows are left out."""
    for name, df in relations.items():
        if as_of_ms is not None and "expire_at_ms" in df.columns:
            df = df.filter(live(as_of_ms))
        df.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names or SCHEMAS}
