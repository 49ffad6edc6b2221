"""A log of commands replayed into relations, and relations compacted into the log that rebuilds them.

Commands on several keys are cut into one for each key where that changes nothing (DEL, UNLINK, MSET). Keys that RENAME,
RENAMENX or MSETNX tie together are replayed together; all others by themselves. What lies before a flush of its database, or
before the last command that sets or deletes its key whatever it held, is left out. Of keys with commands of only sets, hashes
or scored sets the last command on each member decides, by an aggregate that splits hot keys. The rest runs in order, streamed
through :class:`Keyspace`: a task holds the value of the key that it is at, never its commands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.log.interpreter import SCORE, Keyspace
from keyloom.session import need_checkpoints

STATE = "db int, key string, type string, pos long, field string, value string, score double, fields map<string,string>, expire_at_ms long"
_ARROW = [
    ("db", pa.int32()), ("key", pa.string()), ("type", pa.string()), ("pos", pa.int64()), ("field", pa.string()), ("value", pa.string()),
    ("score", pa.float64()), ("fields", pa.map_(pa.string(), pa.string())), ("expire_at_ms", pa.int64()), ("errors", pa.int64()),
]
#: Elements or members in one command of a compacted log.
CHUNK = 64


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    arrays = [pa.array([None if x is None else list(x.items()) for x in c] if n == "fields" else c, t) for c, (n, t) in zip(columns, _ARROW)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in _ARROW])


def in_order(log: DataFrame, group: str, order: list[str], as_of_ms: int = 0) -> DataFrame:
    """What the commands (db, cmd, argv, ts_ms) of each ``group`` leave, run in order: STATE and ``errors`` of the group.

    ``argv`` begins with the key. A group that leaves nothing gives one row of type none, with its name as the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_, at, errors, out = None, Keyspace(as_of_ms), 0, []

        def done() -> Iterator[pa.RecordBatch]:
            empty = True
            for r in at.rows():
                empty = False
                out.append((*r, errors))
                if len(out) >= 4096:
                    yield _batch(out)
                    out.clear()
            if empty:
                out.append((None, group_, "none", 0, None, None, None, None, None, errors))

        for b in batches:
            for g, db, cmd, argv, ts in zip(*(b.column(i).to_pylist() for i in range(5))):
                if g != group_:
                    if group_ is not None:
                        yield from done()
                    group_, at, errors = g, Keyspace(as_of_ms), 0
                bad = cmd is None or argv is None or None in argv
                errors += bad or at.apply(cmd, argv, db, as_of_ms if ts is None else ts) is not None
        if group_ is not None:
            yield from done()
        if out:
            yield _batch(out)

    rows = log.select(F.col(group).alias("g"), "db", "cmd", "argv", "ts_ms", *order).repartition("g").sortWithinPartitions("g", *order)
    return rows.select("g", "db", "cmd", "argv", "ts_ms").mapInArrow(run, STATE + ", errors long")


def roots(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b): the least node that it is tied to.

    Each round takes the least root among the neighbours, then the root of that root, and is checkpointed, so a lost
    executor costs one round.
    """
    need_checkpoints(links.sparkSession)
    both = links.select("a", "b").union(links.select("b", "a")).distinct().checkpoint()
    at = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node").checkpoint()
    while True:
        near = both.join(at, both.b == at.node).groupBy("a").agg(F.min("root").alias("near"))
        next_ = at.join(near, F.col("a") == F.col("node")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = next_.select(F.col("node").alias("root"), F.col("root").alias("above"))
        next_ = next_.join(up, "root", "left").select("node", "old", F.least("root", "above").alias("root")).checkpoint()
        at = next_.select("node", "root")
        if next_.filter("root <> old").isEmpty():
            return at


def _single(log: DataFrame) -> DataFrame:
    """Commands cut into one for each key where the keys don't depend on each other."""
    argv, n = F.col("argv"), F.size("argv")
    keys = F.transform(argv, lambda k: F.struct(F.col("cmd").alias("cmd"), F.array(k).alias("argv")))
    sets = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda i: F.struct(F.lit("SET").alias("cmd"), F.slice(argv, i * 2 + 1, 2).alias("argv")))
    cut = F.when(F.col("cmd").isin("DEL", "UNLINK"), keys).when((F.col("cmd") == "MSET") & (n >= 2) & (n % 2 == 0), sets)
    whole = F.array(F.struct(F.col("cmd").alias("cmd"), argv.alias("argv")))
    rest = [c for c in log.columns if c not in ("cmd", "argv")]
    return log.select(*rest, F.posexplode(F.coalesce(cut, whole)).alias("part", "x")).select(*rest, "part", "x.cmd", "x.argv").withColumn("key", F.try_element_at("argv", F.lit(1)))


def _scores_valid() -> Column:
    scores = F.filter("argv", lambda x, i: i % 2 == 1)
    return (F.size("argv") >= 3) & (F.size("argv") % 2 == 1) & F.forall(scores, lambda x: x.rlike(SCORE))


def _family() -> Column:
    """1 for what must run in order, 2, 4, 8 for commands that sets, hashes and scored sets take member by member, 0 for deletions."""
    cmd, n = F.col("cmd"), F.size("argv")
    return (
        F.when(F.exists("argv", lambda x: x.isNull()), 1)
        .when(cmd.isin("DEL", "UNLINK"), 0)
        .when(cmd.isin("SADD", "SREM") & (n >= 2), 2)
        .when(cmd.isin("HSET", "HMSET") & (n >= 3) & (n % 2 == 1) | (cmd == "HDEL") & (n >= 2), 4)
        .when((cmd == "ZADD") & _scores_valid() | (cmd == "ZREM") & (n >= 2), 8)
        .otherwise(1)
    )


def _by_member(log: DataFrame) -> DataFrame:
    """The members that keys of one family hold at the end: of each the last command on it decides."""
    cmd, rest = F.col("cmd"), F.expr("slice(argv, 2, size(argv) - 1)")
    cell = lambda m, value, score, add: F.struct(m.alias("field"), value.cast("string").alias("value"), score.alias("score"), F.lit(add).alias("add"))
    none, nan = F.lit(None).cast("string"), F.lit(None).cast("double")
    odd = F.filter("argv", lambda x, i: i % 2 == 1)
    even = F.filter("argv", lambda x, i: (i % 2 == 0) & (i > 0))
    cells = (
        F.when(cmd == "SADD", F.transform(rest, lambda m: cell(m, none, nan, True)))
        .when(cmd.isin("HSET", "HMSET"), F.zip_with(odd, even, lambda f, v: cell(f, v, nan, True)))
        .when(cmd == "ZADD", F.zip_with(odd, even, lambda s, m: cell(m, none, s.try_cast("double"), True)))
        .when(cmd.isin("SREM", "HDEL", "ZREM"), F.transform(rest, lambda m: cell(m, none, nan, False)))
    )
    ops = log.select("db", "key", "families", "at", F.posexplode(cells).alias("i", "c"))
    last = ops.groupBy("db", "key", "families", "c.field").agg(F.max_by("c", F.struct("at", "i")).alias("c")).filter("c.add")
    kind = F.when(F.col("families") == 2, "set").when(F.col("families") == 4, "hash").otherwise("zset")
    null = lambda t: F.lit(None).cast(t)
    return last.select("db", "key", kind.alias("type"), null("long").alias("pos"), "field", F.col("c.value").alias("value"), F.col("c.score").alias("score"), null("map<string,string>").alias("fields"), null("long").alias("expire_at_ms"))


def replay(log: DataFrame, as_of_ms: int, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """What a log (db, cmd, argv, and its ``order``) leaves at ``as_of_ms``: one STATE row for each string, element, field or member.

    ``order`` names columns that put the commands of a database in order without ties, as seq, or file and n. Without ``db`` the
    commands are for database 0; without ``ts_ms``, or where it is null, they run at ``as_of_ms``. Commands without effect
    (errors, unknown or reading ones, null arguments) are passed over. Any log with RENAME, RENAMENX or MSETNX takes
    rounds over the keys so tied, and they are replayed in one task. The log is read three times, so write one that is costly to
    make. A list, string or stream of one key is held by one task.
    """
    given = log.columns
    db = F.coalesce(F.col("db").cast("int"), F.lit(0)) if "db" in given else F.lit(0)
    ts = F.col("ts_ms").cast("long") if "ts_ms" in given else F.lit(None).cast("long")
    rows = log.select(db.alias("db"), F.upper("cmd").alias("cmd"), F.coalesce("argv", F.array().cast("array<string>")).alias("argv"), ts.alias("ts_ms"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    place = [f"o{i}" for i in range(len(order))]
    first = F.struct(*place)
    # One row for each database that was flushed, and one for all.
    flushed = rows.filter("cmd in ('FLUSHDB', 'FLUSHALL')").groupBy(F.when(F.col("cmd") == "FLUSHDB", F.col("db")).alias("fdb")).agg(F.max(first).alias("f"))
    every = flushed.filter("fdb is null").select(F.col("f").alias("fa"))
    rows = rows.filter("cmd not in ('FLUSHDB', 'FLUSHALL')")
    one = flushed.filter("fdb is not null")
    rows = rows.join(F.broadcast(one), rows.db == one.fdb, "left").join(F.broadcast(every), F.lit(True), "left")
    rows = rows.filter((F.col("f").isNull() | (first > F.col("f"))) & (F.col("fa").isNull() | (first > F.col("fa")))).drop("fdb", "f", "fa")
    rows = _single(rows).filter("key is not null").withColumn("at", F.struct(*place, "part")).withColumn("node", F.concat_ws(":", F.col("db").cast("string"), "key"))
    tied = rows.filter("cmd in ('RENAME', 'RENAMENX', 'MSETNX')")
    node = lambda k: F.concat_ws(":", F.col("db").cast("string"), k)
    others = F.when(F.col("cmd") == "MSETNX", F.filter("argv", lambda x, i: i % 2 == 0)).otherwise(F.slice("argv", 1, 2))
    links = tied.select("node", F.explode(others).alias("other"), "db").filter("other is not null").select(F.col("node").alias("a"), node("other").alias("b"))
    whole = (F.col("cmd") == "SET") & (F.size("argv") == 2) | F.col("cmd").isin("DEL", "UNLINK")
    keys = rows.groupBy("node").agg(F.max(F.when(whole & ~F.exists("argv", lambda x: x.isNull()), F.col("at"))).alias("reset"), F.bit_or(_family()).alias("families"))
    keys = keys.withColumns({"g": F.col("node"), "alone": F.lit(True)})
    if not links.isEmpty():
        root = roots(links)
        keys = keys.drop("g", "alone").join(root, "node", "left").withColumns({"alone": F.col("root").isNull(), "g": F.coalesce("root", "node")}).drop("root")
    rows = rows.join(keys, "node")
    rows = rows.filter(~F.col("alone") | F.col("reset").isNull() | (F.col("at") >= F.col("reset")))
    split = F.col("alone") & F.col("families").isin(2, 4, 8)
    ordered = in_order(rows.filter(~split), "g", [*place, "part"], as_of_ms).filter("type <> 'none'").drop("errors")
    return _by_member(rows.filter(split)).unionByName(ordered).filter(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") >= as_of_ms))


def relation(state: DataFrame, name: str) -> DataFrame:
    """The rows of a replay as one of the relations of ``schema.SCHEMAS``."""
    of = {
        "kv_string": ("string", ["value"]),
        "kv_list": ("list", ["pos", "value as element"]),
        "kv_hash": ("hash", ["field", "value", "cast(null as long) as field_expire_at_ms"]),
        "kv_set": ("set", ["field as member"]),
        "kv_zset": ("zset", ["field as member", "score"]),
        "kv_stream": ("stream", ["cast(split_part(field, '-', 1) as long) as id_ms", "cast(split_part(field, '-', 2) as long) as id_seq", "fields"]),
    }
    kind, columns = of[name]
    end = [] if name == "kv_stream" else ["expire_at_ms"]
    return state.filter(F.col("type") == kind).selectExpr("db", "key", *columns, *end)


def compact(relations: dict[str, DataFrame]) -> DataFrame:
    """seq, db, cmd, argv: the log that builds the relations (by their names in ``schema.SCHEMAS``) again.

    Elements, fields and members come about 64 to a command, keys with an expiry get a PEXPIREAT after them. Fields with an
    expiry of their own keep their value and lose that time, since no command of the log states it. Rows with a null key are
    left out. Hot keys are cut into chunks before anything of theirs is collected.
    """
    parts, ends = [], []
    for name, df in relations.items():
        db = F.coalesce(F.col("db").cast("int"), F.lit(0)) if "db" in df.columns else F.lit(0)
        end = F.col("expire_at_ms") if "expire_at_ms" in df.columns else F.lit(None).cast("long")
        t = df.filter("key is not null").withColumns({"db": db, "expire_at_ms": end})
        ends.append(t.filter("expire_at_ms is not null").groupBy("db", "key").agg(F.max("expire_at_ms").alias("e")))
        text = lambda c: F.col(c).cast("string")
        if name == "kv_string":
            parts.append(t.select("db", "key", F.lit(0).alias("part"), F.lit(0).alias("sub"), F.lit("SET").alias("cmd"), F.array("key", text("value")).alias("argv")))
            continue
        if name == "kv_stream":
            given = F.flatten(F.transform(F.map_entries("fields"), lambda x: F.array(x["key"], x["value"])))
            entry = F.concat_ws("-", text("id_ms"), text("id_seq"))
            parts.append(t.select("db", "key", F.col("id_ms").alias("part"), F.col("id_seq").alias("sub"), F.lit("XADD").alias("cmd"), F.concat(F.array("key", entry), given).alias("argv")))
            continue
        cmd, order, cells = {
            "kv_list": ("RPUSH", "pos", ["element"]),
            "kv_hash": ("HSET", "field", ["field", "value"]),
            "kv_set": ("SADD", "member", ["member"]),
            "kv_zset": ("ZADD", "member", ["score", "member"]),
        }[name]
        if name == "kv_list":
            t = t.withColumn("part", F.expr(f"pos div {CHUNK}"))
        else:
            sizes = t.groupBy("db", "key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
            t = t.join(sizes, ["db", "key"]).withColumn("part", F.pmod(F.xxhash64(order), F.col("chunks")))
        some = t.groupBy("db", "key", "part").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.array(*map(text, cells)).alias("x")))).alias("xs"))
        flat = F.flatten(F.transform("xs", lambda s: s["x"]))
        parts.append(some.select("db", "key", "part", F.lit(0).alias("sub"), F.lit(cmd).alias("cmd"), F.concat(F.array("key"), flat).alias("argv")))
    last = reduce(DataFrame.unionByName, ends).groupBy("db", "key").agg(F.max("e").alias("e"))
    parts.append(last.select("db", "key", F.lit(2**63 - 1).alias("part"), F.lit(0).alias("sub"), F.lit("PEXPIREAT").alias("cmd"), F.array("key", F.col("e").cast("string")).alias("argv")))
    every = reduce(DataFrame.unionByName, [p.withColumns({"part": F.col("part").cast("long"), "sub": F.col("sub").cast("long")}) for p in parts])
    # Numbers grow with the range partitions, so a key's commands keep their order even where it spans several.
    by = ["db", "key", "part", "sub"]
    return every.repartitionByRange(*by).sortWithinPartitions(*by).select(F.monotonically_increasing_id().alias("seq"), "db", "cmd", "argv")
