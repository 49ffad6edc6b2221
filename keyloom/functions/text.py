"""Glob patterns, byte slices, indexes and number text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of ``*``, ``?``, ``[a-z]`` and ``[^a]``; nothing else is special."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        stop = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif stop > 0:
            body = pattern[i + 1 : stop]
            no = body.startswith("^")
            out.append("[" + "^" * no + re.sub(r"([\\\[\]^&])", r"\\\1", body[no:]) + "]")
            i = stop
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(c: Column, pattern: str) -> Column:
    """Does the column match? A pattern without special characters, or with only a last ``*``, becomes a pushable filter."""
    if not re.search(r"[*?\[]", pattern):
        return c == pattern
    if pattern.endswith("*") and not re.search(r"[*?\[]", pattern[:-1]):
        return c.startswith(pattern[:-1])
    return c.rlike(glob_regex(pattern))


def first_last(start: int, stop: int, n: Column) -> tuple[Column, Column]:
    """Zero-based inclusive bounds from indexes that may count from the end, clamped; empty if first > last."""
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    last = F.least(F.lit(stop), n - 1) if stop >= 0 else n + stop
    return first.cast("long"), last.cast("long")


def byte_slice(value: Column, start: int, stop: int) -> Column:
    """The inclusive byte range of a text, as text."""
    b = value.cast("binary")
    first, last = first_last(start, stop, F.octet_length(value))
    n = F.greatest(last - first + 1, F.lit(0))
    return F.substring(b, (first + 1).cast("int"), n.cast("int")).cast("string")


def byte_overlay(value: Column, offset: int, new: str) -> Column:
    """``new`` written over a text's bytes from ``offset``; a gap is filled with zero bytes."""
    if offset < 0:
        raise ValueError("offset is out of range")
    b = value.cast("binary")
    padded = F.rpad(b, offset, F.lit(b"\x00")) if offset else F.lit(b"")
    head = F.when(F.octet_length(value) >= offset, F.substring(b, F.lit(1), F.lit(offset))).otherwise(padded)
    tail = F.substring(b, F.lit(offset + len(new.encode()) + 1), F.lit(2**31 - 1))
    return F.concat(head, F.lit(new.encode()), tail).cast("string")


def is_integer(value: Column) -> Column:
    """Does the text hold a signed 64-bit integer, with nothing around it?"""
    return value.rlike(r"^[+-]?[0-9]+$") & F.try_to_number(value, F.lit("S9999999999999999999")).isNotNull() & value.try_cast("long").isNotNull()


def integer(value: Column) -> Column:
    """The 64-bit integer of a text, or null."""
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("long"))


def float_text(x: Column) -> Column:
    """A double as text: whole numbers under 1e15 without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def string_encoding(value: Column) -> Column:
    return F.when(integer(value).isNotNull(), "int").when(F.octet_length(value) <= 44, "embstr").otherwise("raw")
