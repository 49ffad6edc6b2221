"""Cardinality sketches over (key, element)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers are 2**PRECISION; the standard error is about 0.81 %.
PRECISION = 14


def add(rows: DataFrame, element: str = "element") -> DataFrame:
    """key, sketch of PFADD; partial sketches are built before the shuffle."""
    return rows.groupBy("key").agg(F.hll_sketch_agg(element, PRECISION).alias("sketch"))


def count(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))


def count_together(sketches: DataFrame) -> DataFrame:
    """PFCOUNT of several keys: one estimate of their union."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def merge(sketches: DataFrame, target: str) -> DataFrame:
    """PFMERGE: target, sketch."""
    return sketches.agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit(target).alias("key"), "sketch")
