"""52-bit interleaved geohash cells and great-circle distance."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits for each axis, Earth radius in metres, degrees covered by each axis, base-32 digits, metres in a unit.
BITS, RADIUS = 26, 6372797.560856
LON, LAT = (-180.0, 180.0), (-90.0, 90.0)
LAT_LIMIT = 85.05112878
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}


def _cell(x: Column, low: float, high: float) -> Column:
    return F.floor((x - low) / (high - low) * float(1 << BITS)).cast("long")


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _folded(move: Callable[[Column, int], Column], shift: int, mask: int) -> Callable[[Column], Column]:
    return lambda v: v.bitwiseOR(move(v, shift)).bitwiseAND(F.lit(mask).cast("long"))


def _spread(x: Column) -> Column:
    """Bit i of x at bit 2i, by five masked shifts."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = _bound(x, _folded(F.shiftleft, shift, mask))
    return x


def _gather(x: Column) -> Column:
    """The inverse: every other bit, close together."""
    x = x.bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = _bound(x, _folded(F.shiftright, shift, mask))
    return x


def near_cells(lon: float, lat: float, metres: float) -> list[tuple[int, int]]:
    """First and last 52-bit cell of the ranges that cover all points within a distance; at most a few dozen.

    The box around the circle is covered by squares of the coarser grid whose squares are about as large as the box.
    """
    up = math.degrees(metres / RADIUS) + 1e-6
    south, north = max(lat - up, LAT[0]), min(lat + up, LAT[1])
    top = max(abs(south), abs(north))
    wide = 180.0 if top + up >= 90 or metres / RADIUS >= math.pi / 2 else math.degrees(math.asin(min(1.0, math.sin(metres / RADIUS) / math.cos(math.radians(lat))))) + 1e-6
    level = 0
    while level < BITS and (LON[1] - LON[0]) / 2 ** (level + 1) >= min(wide, 90.0) / 2 and (LAT[1] - LAT[0]) / 2 ** (level + 1) >= up / 2:
        level += 1
    n = 1 << level
    at = lambda v, axis: math.floor((v - axis[0]) / (axis[1] - axis[0]) * n)
    columns = range(n) if 2 * wide >= 360 or at(lon + wide, LON) - at(lon - wide, LON) + 1 >= n else {c % n for c in range(at(lon - wide, LON), at(lon + wide, LON) + 1)}
    shift, out = 2 * (BITS - level), []
    for c in columns:
        for r in range(max(0, at(south, LAT)), min(n - 1, at(north, LAT)) + 1):
            square = sum((c >> i & 1) << 2 * i | (r >> i & 1) << 2 * i + 1 for i in range(level))
            out.append((square << shift, (square + 1 << shift) - 1))
    joined: list[tuple[int, int]] = []
    for lo, hi in sorted(out):
        if joined and joined[-1][1] + 1 == lo:
            joined[-1] = joined[-1][0], hi
        else:
            joined.append((lo, hi))
    return joined


def encode(lon: Column, lat: Column) -> Column:
    """Longitude bits at even places, latitude bits at odd ones; what overflows an axis wraps to its start."""
    wrap = F.lit((1 << BITS) - 1).cast("long")
    return _spread(_cell(lon, *LON).bitwiseAND(wrap)).bitwiseOR(F.shiftleft(_spread(_cell(lat, *LAT).bitwiseAND(wrap)), 1))


def decode(cell: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the cell's lower corner."""
    size = float(1 << BITS)
    lon = _gather(cell).cast("double") / size * (LON[1] - LON[0]) + LON[0]
    lat = _gather(F.shiftright(cell, 1)).cast("double") / size * (LAT[1] - LAT[0]) + LAT[0]
    return lon, lat


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def text(cell: Column) -> Column:
    """Eleven base-32 digits of the cell, least significant first."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.substring(F.lit(ALPHABET), _digit(cell, i) + 1, F.lit(1))), "")


def _digit(cell: Column, i: Column) -> Column:
    return (F.floor(cell / F.pow(F.lit(32.0), i)).cast("long") % 32).cast("int")
