"""A Spark session with the settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "keyloom", **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive execution; ``conf`` overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(name)
    base = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def need_checkpoints(spark: SparkSession) -> None:
    """See to it that ``checkpoint()`` has a folder: ``spark.checkpoint.dir``, or in one process, where that is unset, one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, found, True)
    sc.setCheckpointDir(found)
