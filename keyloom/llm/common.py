"""What the operators share: the shared folder, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_scratch: dict[str, list[tuple[SparkSession, str]]] = {}
_owner: ContextVar[str] = ContextVar("owner", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is empty and Spark runs in one process (tests), a temporary folder is made and
    set; on a cluster an empty setting is an error, since a machine-local folder would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="keyloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def new_folder(spark: SparkSession, name: str, scratch: bool = True) -> str:
    """A path below the shared folder that no other call uses; a scratch one is its owner's, and :func:`release` deletes it."""
    path = f"{shared_dir(spark)}/keyloom/{name}-{uuid.uuid4().hex}"
    if scratch:
        _scratch.setdefault(_owner.get(), []).append((spark, path))
    return path


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables made inside belong to ``owner``, so that others' results, perhaps still unread, outlive its release."""
    before = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(before)


def written(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_folder(spark, name, scratch)
    df.write.parquet(path)
    free(spark)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` as a table written in as many buckets of ``by`` as there are shuffle partitions: joins by it shuffle the other side only."""
    spark, n = df.sparkSession, partitions_for(df)
    path, table = new_folder(spark, name), f"keyloom_{name}_{uuid.uuid4().hex}"
    df.repartition(n, by).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, by).saveAsTable(table)
    free(spark)
    return spark.table(table)


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now; else they stay until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(owner: str | None = None) -> None:
    """Delete the intermediate tables that ``owner`` (None: anyone) made so far. Only for callers whose results are already written."""
    for name in [owner] if owner is not None else list(_scratch):
        for spark, path in _scratch.pop(name, []):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one thing at a time, so that operators run in turn don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what the worker process keeps; for tasks that keep nothing and need the room."""
    _kept.clear()


def two(df: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns an operator works on, whatever else ``df`` holds: ``doc_id`` long and ``text`` string."""
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, to bound what is unpacked at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
