"""Append-only command logs in the multi-bulk text format: ``*n``, then ``$len`` and an argument, n times."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(data: bytes) -> Iterator[list[bytes]]:
    """Commands of a log; an inline line is split at spaces; an unfinished last command is left out."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n", at)
        if end < 0:
            return
        line = data[at:end]
        at = end + 2
        if not line.startswith(b"*"):
            if line.strip():
                yield line.split()
            continue
        args = []
        for _ in range(int(line[1:])):
            end = data.find(b"\r\n", at)
            if end < 0:
                return
            if data[at : at + 1] != b"$":
                raise ValueError("expected a bulk string")
            size = int(data[at + 1 : end])
            if end + 2 + size + 2 > n:
                return
            args.append(data[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
        yield args


def encode(args: list[str]) -> bytes:
    out = [b"*%d\r\n" % len(args)]
    for a in args:
        b = a.encode()
        out.append(b"$%d\r\n%s\r\n" % (len(b), b))
    return b"".join(out)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """file, n, db, cmd, argv of the log files below a path; SELECT sets the database of what follows it in its file.

    A file is one task's work; write logs in segments to read them in parallel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                db, rows = 0, []
                for i, args in enumerate(parse(content)):
                    cmd, *rest = [a.decode(errors="replace") for a in args]
                    if cmd.upper() == "SELECT":
                        db = int(rest[0])
                        continue
                    rows.append((file, i, db, cmd.upper(), rest))
                for s in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[s : s + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())))], ["file", "n", "db", "cmd", "argv"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, n long, db int, cmd string, argv array<string>")


def log_text(log: DataFrame) -> DataFrame:
    """One column ``value``: each command (cmd, argv, and db if there is one) encoded, for the text writer.

    A command of another database than 0 stands between two SELECTs, so a log may be cut into files anywhere.
    """

    def bulk(args):
        each = F.transform(args, lambda a: F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a))
        return F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"), F.array_join(each, "\r\n"))

    one = bulk(F.concat(F.array("cmd"), "argv"))
    if "db" in log.columns:
        select = lambda db: bulk(F.array(F.lit("SELECT"), db))
        other = F.concat_ws("\r\n", select(F.col("db").cast("string")), one, select(F.lit("0")))
        one = F.when(F.coalesce("db", F.lit(0)) == 0, one).otherwise(other)
    return log.select(one.alias("value"))


def write_log(log: DataFrame, path: str) -> None:
    """Write a log (seq, cmd, argv, and db if there is one) in order, as files that :func:`read_log` reads."""
    log_text(log.repartitionByRange("seq").sortWithinPartitions("seq")).write.option("lineSep", "\r\n").text(path)
