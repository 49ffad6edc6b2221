"""Scripts are registered Python functions over relations, found by name or by the SHA-1 of their source."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.errors import NoScript


class Scripts:
    """A registry: load, exists, run, flush. A script takes (relations, keys, args) and returns a DataFrame."""

    def __init__(self) -> None:
        self._by_sha: dict[str, Callable] = {}

    def load(self, f: Callable, source: str | None = None) -> str:
        sha = hashlib.sha1((source or inspect.getsource(f)).encode()).hexdigest()
        self._by_sha[sha] = f
        return sha

    def exists(self, *shas: str) -> list[bool]:
        return [s in self._by_sha for s in shas]

    def run(self, sha: str, relations: dict[str, DataFrame], keys: list[str], args: list[str]) -> DataFrame:
        if sha not in self._by_sha:
            raise NoScript("no matching script")
        return self._by_sha[sha](relations, keys, args)

    def call(self, calls: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
        """seq, reply, error of calls (seq, sha, ...): each registered script, a function of (relations, its calls) that returns
        seq and reply, answers all calls of its digest at once; the error of a digest that isn't registered, or null, is NOSCRIPT."""
        unknown = calls.filter(~F.coalesce(F.col("sha").isin(*self._by_sha), F.lit(False)))
        out = unknown.select("seq", F.lit(None).cast("string").alias("reply"), F.lit("NOSCRIPT").alias("error"))
        for sha, f in self._by_sha.items():
            out = out.unionByName(f(relations, calls.filter(F.col("sha") == sha)).select("seq", F.col("reply").cast("string").alias("reply"), F.lit(None).cast("string").alias("error")))
        return out

    def flush(self) -> None:
        self._by_sha.clear()


def digests(scripts: DataFrame) -> DataFrame:
    """src, sha1 of scripts given as rows."""
    return scripts.select("src", F.sha1(F.col("src").cast("binary")).alias("sha1"))
