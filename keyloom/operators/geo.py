"""Geospatial commands: a geo set is a sorted set whose score is a 52-bit cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import geohash as G


def add(points: DataFrame) -> DataFrame:
    """key, member, score of points (key, member, lon, lat); points outside the limits are left out."""
    ok = F.col("lon").between(-180.0, 180.0) & F.col("lat").between(-G.LAT_LIMIT, G.LAT_LIMIT)
    return points.filter(ok).select("key", "member", G.encode(F.col("lon"), F.col("lat")).cast("double").alias("score"))


def position(z: DataFrame) -> DataFrame:
    lon, lat = G.decode(F.col("score").cast("long"))
    return z.select("key", "member", lon.alias("lon"), lat.alias("lat"))


def distance(z: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """key, a, b, distance (4 decimals) of ``pairs`` (key, a, b)."""
    p = position(z)
    j = pairs.join(p.select("key", F.col("member").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), ["key", "a"]).join(p.select("key", F.col("member").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), ["key", "b"])
    d = G.distance(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) / G.UNITS[unit]
    return j.select("key", "a", "b", F.round(d, 4).alias("distance"))


def hash_text(z: DataFrame) -> DataFrame:
    return z.select("key", "member", G.text(F.col("score").cast("long")).alias("hash"))


def _near(z: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """The rows whose cells lie in the ranges around a circle."""
    return z.filter(reduce(Column.__or__, [F.col("score").between(float(a), float(b)) for a, b in G.near_cells(lon, lat, metres)]))


def search(z: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", count: int | None = None, descending: bool = False) -> DataFrame:
    """key, member, lon, lat, metres within a radius, nearest first if counted.

    Scores are tested against the few ranges of cells around the centre first, which a scan can prune by; only
    what lies in them is decoded.
    """
    metres = radius * G.UNITS[unit]
    p = position(_near(z, lon, lat, metres))
    p = p.withColumn("metres", G.distance(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))).filter(F.col("metres") <= metres)
    if count:
        p = p.orderBy(F.col("metres").desc() if descending else F.col("metres"), "member").limit(count)
    return p


def search_box(z: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m", true_box: bool = False, count: int | None = None) -> DataFrame:
    """BYBOX: by default a circle of half the longer side; with ``true_box`` both axes are measured."""
    if not true_box:
        return search(z, lon, lat, max(width, height) / 2, unit, count)
    m = G.UNITS[unit]
    p = position(_near(z, lon, lat, (width + height) * m / 2)).withColumn("metres", G.distance(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)))
    x, y = G.distance(F.col("lon"), F.col("lat"), F.lit(lon), F.col("lat")), G.distance(F.lit(lon), F.col("lat"), F.lit(lon), F.lit(lat))
    p = p.filter((x <= width * m / 2) & (y <= height * m / 2))
    return p.orderBy("metres", "member").limit(count) if count else p


def search_store(z: DataFrame, target: str, found: DataFrame) -> DataFrame:
    """The relation with what was found added to ``target``, which isn't cleared."""
    from keyloom.operators.zsets import add as zadd

    cells = z.join(found.select("key", "member"), ["key", "member"], "left_semi").select(F.lit(target).alias("key"), "member", "score")
    return zadd(z, cells)
