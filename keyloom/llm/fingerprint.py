"""Document fingerprints by one-permutation MinHash, in Spark expressions only.

The shingles of a text are hashed once. The high bits of a hash name its bin, and each bin keeps its
least hash. Empty bins are filled by optimal densification: each has its own random order of the bins
and copies the first in that order that isn't empty, so that two texts agree on a copied bin as often as on
one of their own. The low bits of each bin's hash are stored, packed; chance agreements of
so few bits are taken out when two fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins (a power of two), bits stored of each, words in a shingle.
BINS, BITS, WORDS = 128, 8, 5
_SHIFT = 64 - BINS.bit_length() + 1


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of ``words`` words; of fewer words, one of them all; of none, none."""

    def of(w: Column) -> Column:
        # Word hashes are mixed with odd multipliers by place, then once more.
        run = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)])
        return F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), run)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    split = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    return let(F.transform(split, lambda x: F.xxhash64(x)), of)


def _bin(h: Column) -> Column:
    return F.shiftright(h, _SHIFT) + F.lit(BINS // 2)


def codes(text: Column) -> Column:
    """A fingerprint as an array of BINS small numbers; empty where the text has no words."""

    def dense(least: Column) -> Column:
        # least: of each bin that isn't empty its least hash, by bin.
        def filled(by_bin: Column) -> Column:
            def at(b: Column) -> Column:
                own = F.get(least, F.array_position(by_bin, b).cast("int") - 1)
                copied = F.array_min(F.transform(least, lambda m: F.struct(F.xxhash64(b, _bin(m)).alias("turn"), m.alias("m")))).m
                return F.coalesce(own, copied)

            return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), at)

        return F.when(F.size(least).isin(0, BINS), least).otherwise(let(F.transform(least, _bin), filled))

    least = let(F.sort_array(shingle_hashes(text)), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))
    return F.transform(let(least, dense), lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint"))


def packed(c: Column) -> Column:
    """The stored form: BITS bits of each bin as lower-case hex digits; empty for a text without words."""
    return F.lower(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("bigint")), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two code arrays (0 to 1), free of the bias of chance agreement.

    Two texts without words are alike (1); one without and one with are not (0).
    """
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, codes of every row; null texts are empty, other columns are ignored."""
    return docs.select(docs[key].cast("long").alias("doc_id"), codes(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("codes")).select("doc_id", packed(F.col("codes")).alias("fingerprint"), "codes")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``: first among every n-th of them, then among the n."""
    n = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + n] for i in range(0, len(bounds), n)] or [[]]
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x <= k))
    if len(groups) == 1:
        return count(F.lit(groups[0]).cast("array<bigint>"), key) if bounds else F.lit(0)
    heads = F.lit([g[0] for g in groups]).cast("array<bigint>")
    all_groups = F.array(*[F.lit(g).cast("array<bigint>") for g in groups])
    g = count(heads, key)
    return F.when(g == 0, 0).otherwise((g - 1) * n + count(F.get(all_groups, g - 1), key))


def with_next(docs: DataFrame, columns: list[str], buckets: int, key: str = "doc_id") -> DataFrame:
    """Each row with ``columns`` of the next row by falling ``key`` (after the last, the first) as ``next_...``.

    One shuffle: rows go to ranges of the key, and the first rows of each range also to the range that
    comes before it, so no range needs another. The key's quantiles and each range's largest key,
    at most ``buckets`` of each, are all that the driver sees. Equal keys are ordered by ``columns``; null
    keys come last.
    """
    spark = docs.sparkSession
    d = docs.withColumn("__k", F.coalesce(docs[key], F.lit(-(1 << 63))))
    share = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(d.agg(F.percentile_approx("__k", F.lit(share), 20 * buckets).alias("b")).first().b or [])) if share else []
    d = d.withColumn("__p", _place(F.col("__k"), bounds).cast("int"))
    heads = sorted((r["__p"], r.top) for r in d.select("__p", "__k").groupBy("__p").agg(F.max("__k").alias("top")).collect())
    to = [(top, heads[(i + 1) % len(heads)][0]) for i, (_, top) in enumerate(heads)]
    guests = spark.sql("SELECT * FROM VALUES " + ", ".join(f"(CAST('{a}' AS BIGINT), {b})" for a, b in to or [(0, 0)]) + " AS t(__top, __to)")
    d = d.join(F.broadcast(guests), F.col("__k") == F.col("__top"), "left")
    here, there = F.struct(F.col("__p").alias("p"), F.lit(False).alias("guest")), F.struct(F.col("__to").alias("p"), F.lit(True).alias("guest"))
    d = d.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    w = Window.partitionBy("__at.p").orderBy(F.col("__at.guest"), F.col("__k").desc(), *columns)
    return d.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("not __at.guest").drop("__k", "__p", "__top", "__to", "__at")


def edited(text: Column, following: Column) -> Column:
    """The text with the last half of its code points replaced by the first as many of the following one's."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
