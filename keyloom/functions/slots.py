"""Hash slots: CRC16 (XMODEM) of the key, or of its ``{tag}``, modulo 16384."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS, POLYNOMIAL = 16384, 0x1021


def _table() -> list[int]:
    out = []
    for i in range(256):
        crc = i << 8
        for _ in range(8):
            crc = (crc << 1 ^ (POLYNOMIAL if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


def crc16(text: Column) -> Column:
    """CRC16 over the text's bytes, as one fold with a literal table."""
    table = F.lit(_table())
    b = text.cast("binary")
    byte = lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int")
    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        places,
        F.lit(0),
        lambda crc, i: F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(byte(i)).bitwiseAND(F.lit(0xFF)))),
    )


def hash_tag(key: Column) -> Column:
    """What is hashed: the text between the first ``{`` and the next ``}``, if any, else the key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def key_slot(key: Column) -> Column:
    return (crc16(hash_tag(key)) % SLOTS).cast("int")
