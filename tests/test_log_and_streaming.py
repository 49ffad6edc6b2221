"""Folds against a sequential interpreter, log files, snapshots, and live queries."""

import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from keyloom.log import fold, replay
from keyloom.log.interpreter import Keyspace
from keyloom.plans.commands import SETTINGS, catalogue, rows
from keyloom.schema import keyspace, type_conflicts
from keyloom.sources import resp, snapshot
from keyloom.streaming import groups


def test_counters_and_members(spark):
    random.seed(1)
    log = [(i, random.choice(["SET", "INCRBY", "INCRBY", "DEL"]), f"k{random.randrange(20)}", random.randrange(-50, 50)) for i in range(2000)]
    want: dict = {}
    for _, c, k, v in log:
        if c == "DEL":
            want.pop(k, None)
        else:
            want[k] = v if c == "SET" else want.get(k, 0) + v
    got = fold.counters(spark.createDataFrame(log, "seq long, cmd string, key string, v long"))
    assert {r.key: r.value for r in got.collect()} == want
    ops = [(i, random.choice(["SADD", "SADD", "SREM", "DEL"]), f"k{random.randrange(20)}", str(random.randrange(9))) for i in range(3000)]
    sets: dict = {}
    for _, c, k, m in ops:
        if c == "DEL":
            sets.pop(k, None)
        elif c == "SADD":
            sets.setdefault(k, set()).add(m)
        else:
            sets.get(k, set()).discard(m)
    got = fold.members(spark.createDataFrame(ops, "seq long, cmd string, key string, member string"))
    assert {(r.key, r.member) for r in got.collect()} == {(k, m) for k, s in sets.items() for m in s}


def test_strings_and_general_fold(spark):
    random.seed(2)
    log = [(i, random.choice(["SET", "SETNX", "APPEND", "APPEND", "DEL"]), f"k{random.randrange(10)}", random.choice("xyz")) for i in range(800)]
    at = Keyspace()
    for _, c, k, v in log:
        at.apply(c, [k] if c == "DEL" else [k, v])
    want = {r[1]: r[5] for r in at.rows()}
    df = spark.createDataFrame(log, "seq long, cmd string, key string, value string")
    assert {r.key: r.value for r in fold.strings(df).collect()} == want
    mixed = [(i, *random.choice([("RPUSH", ["a", "b"]), ("LPUSH", ["c"]), ("LPOP", []), ("LREM", ["1", "a"]), ("LSET", ["0", "z"]), ("SET", ["s"]), ("DEL", []), ("INCRBY", ["1"])]), f"k{random.randrange(10)}") for i in range(600)]
    one, errors = Keyspace(), Counter()
    for _, c, a, k in mixed:
        errors[k] += one.apply(c, [k, *a]) is not None
    got = fold.general(spark.createDataFrame([(i, c, k, a) for i, c, a, k in mixed], "seq long, cmd string, key string, argv array<string>")).collect()
    assert sorted((r.key, r.type, r.pos, r.value) for r in got if r.type != "none") == sorted((r[1], r[2], r[3], r[5]) for r in one.rows())
    assert {r.key: r.errors for r in got} == errors and any(errors.values())


def test_whole_relations(spark):
    from keyloom.plans import catalogue
    from keyloom.sources.adapters import Tables

    folder, run = "/root/testdata/sf0.001", catalogue.queries()
    log = Tables(spark, folder).log().orderBy("seq").collect()
    assert {r.cmd for r in log} == {"SET", "INCRBY", "DEL"}
    at = Keyspace()
    for r in log:
        assert at.apply(r.cmd, [r.key] if r.cmd == "DEL" else [r.key, str(r.v)]) is None
    held = {r[1]: r[5] for r in at.rows()}
    got = run["log_fold_general"](spark, folder).collect()
    assert {r.key: r.value for r in got} == {r.key: held.get(r.key) for r in log} and len(got) == len({r.key for r in log})
    aborted = {(w.client_id, w.seq + 30) for w in log for x in log if w.seq < x.seq < w.seq + 30 and x.key == f"u:{w.client_id % 10}"}
    found = [tuple(r) for r in run["txn_watch_conflict"](spark, folder).collect()]
    assert aborted and len(found) == len(aborted) and set(found) == aborted


def _random_command(r, keys):
    k, m, n = r.choice(keys), lambda: r.choice("abcde"), lambda: str(r.randrange(-3, 9))
    two = r.sample(keys, 2)
    return r.choice([
        ["SET", k, n()], ["SET", k, m(), "PX", str(r.randrange(200))], ["SET", k, m(), "NX"], ["SET", k, m(), "XX", "KEEPTTL"], ["SET", k, m(), "PXAT", n(), "EX"],
        ["SETEX", k, "1", m()], ["PSETEX", k, "90", m()], ["SETNX", k, m()], ["GETSET", k, m()], ["MSET", two[0], m(), two[1], n()], ["MSET", k],
        ["DEL", *two], ["UNLINK", k], ["EXPIRE", k, "1"], ["PEXPIRE", k, "70", "NX"], ["EXPIREAT", k, "1"], ["PEXPIREAT", k, "1500", "GT"], ["PERSIST", k],
        ["INCR", k], ["INCRBY", k, n()], ["DECR", k], ["DECRBY", k, n()], ["INCRBY", k, str(2**63 - 1)], ["APPEND", k, m()],
        ["LPUSH", k, m(), m()], ["RPUSH", k, m(), m()], ["LPUSHX", k, m()], ["RPUSHX", k, m()], ["LPOP", k], ["RPOP", k, "2"], ["LSET", k, n(), m()], ["LREM", k, n(), m()],
        ["HSET", k, m(), n(), m(), n()], ["HSET", k, m()], ["HMSET", k, m(), n()], ["HSETNX", k, m(), n()], ["HDEL", k, m(), m()],
        ["SADD", k, m(), m()], ["SREM", k, m()], ["ZADD", k, n(), m(), ".5e1", m()], ["ZADD", k, "x", m()], ["ZADD", k, "GT", n(), m()], ["ZINCRBY", k, n(), m()], ["ZREM", k, m()],
        ["XADD", k, f"{r.randrange(9)}-1", m(), n()], ["PING"], ["GET", k], [None], ["SADD", k, None],
    ])


def _state(rows):
    return sorted((tuple(None if x is None else str(sorted(x.items())) if isinstance(x, dict) else x for x in r) for r in rows), key=repr)


def test_replay_against_the_interpreter(spark):
    r = random.Random(4)
    for tied in (False, True):
        log = []
        for i in range(3000):
            db = r.randrange(3)
            # Keys of one type each, keys of all types, and, where tied, a few that are renamed.
            family = r.choice([["SADD", "SREM", "DEL"], ["HSET", "HDEL", "UNLINK"], ["ZADD", "ZREM", "DEL"]])
            k = f"{family[0]}{r.randrange(6)}"
            c = r.choice(family + family[:1])
            plain = {"SADD": ["a", "b"], "SREM": ["a"], "HSET": ["a", str(i), "b", "x"], "HDEL": ["b", "c"], "ZADD": [str(i / 4), "a", "inf", "b"], "ZREM": ["b"]}
            argv = [c, k, *plain.get(c, [])] if i % 2 else _random_command(r, [f"k{j}" for j in range(40)])
            if tied and i % 40 == 0:
                a, b = r.sample([f"k{j}" for j in range(12)], 2)
                argv = r.choice([["RENAME", a, b], ["RENAMENX", a, b], ["MSETNX", a, "1", b, "2"], ["MSETNX", "k30", "z"]])
            if i in (900, 1400):
                argv = ["FLUSHDB"] if i == 1400 else ["flushall"]
            log.append((i, db, argv[0], argv[1:], i if i % 3 else None))
        now = 3100
        at = Keyspace()
        for i, db, c, argv, ts in log:
            if c is not None and None not in argv:
                at.apply(c.upper(), argv, db, now if ts is None else ts)
        want = [x for x in at.rows() if x[-1] is None or x[-1] >= now]
        df = spark.createDataFrame(log, "seq long, db int, cmd string, argv array<string>, ts_ms long")
        got = replay.replay(df, now)
        assert _state(got.collect()) == _state(want) and {x[2] for x in want} == {"string", "list", "hash", "set", "zset", "stream"}
    empty = replay.replay(df.filter("false"), 0)
    assert empty.collect() == []


def test_roots(spark):
    r = random.Random(5)
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [(f"h{r.randrange(50)}", "hub") for _ in range(99)] + [("one", "one")]
    got = {x.node: x.root for x in replay.roots(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[x] for x in got if x[0] == "n"} == {"n000"} and got["one"] == "one"
    hub = {x for p in links[60:-1] for x in p}
    assert {got[x] for x in hub} == {min(hub)} and set(got) == {x for p in links for x in p}


def test_compact_and_replay(spark, tmp_path):
    end = 9_000_000_000_000
    given = {
        "kv_string": ([(0, "s", "1", None), (2, "t", "", end)], "db int, key string, value string, expire_at_ms long"),
        "kv_list": ([(0, "l", i, f"e{i}", end) for i in range(300)], "db int, key string, pos long, element string, expire_at_ms long"),
        "kv_hash": ([(0, "h", f"f{i}", str(i), None) for i in range(200)], "db int, key string, field string, value string, expire_at_ms long"),
        "kv_set": ([(1, "m", f"x{i}", end) for i in range(200)] + [(1, "m2", "x", None)], "db int, key string, member string, expire_at_ms long"),
        "kv_zset": ([(0, "z", f"x{i}", i / 3, None) for i in range(100)] + [(0, "z", "top", float("inf"), None)], "db int, key string, member string, score double, expire_at_ms long"),
        "kv_stream": ([(0, "e", 5, i, {"a": str(i), "b": ""}) for i in range(50)], "db int, key string, id_ms long, id_seq long, fields map<string,string>"),
    }
    relations = {n: spark.createDataFrame(*g) for n, g in given.items()}
    log = replay.compact(relations)
    most = log.filter("cmd = 'RPUSH'").selectExpr("max(size(argv))").first()[0]
    assert most == 65 and log.select("seq").distinct().count() == log.count()
    resp.write_log(log, str(tmp_path / "log"))
    read = resp.read_log(spark, str(tmp_path / "log"))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    log, read = log.checkpoint(), read.checkpoint()
    for source, order in ((log, ("seq",)), (read, ("file", "n"))):
        state = replay.replay(source, 0, order).checkpoint()
        for n, (rows_, schema) in given.items():
            assert _state(replay.relation(state, n).select(*relations[n].columns).collect()) == _state(rows_), n


def test_log_files(spark, tmp_path):
    commands = [["SET", "k", "a\r\nb"], ["SELECT", "3"], ["RPUSH", "l", "é", ""], ["DEL", "k"]]
    data = b"".join(resp.encode(c) for c in commands)
    assert [[a.decode() for a in c] for c in resp.parse(data + b"*2\r\n$3\r\nGET\r\n$9\r\nx")] == commands
    assert list(resp.parse(b"PING a\r\n\r\n")) == [[b"PING", b"a"]]
    (tmp_path / "one.aof").write_bytes(data)
    got = resp.read_log(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r.db, r.cmd, list(r.argv)) for r in got] == [(0, "SET", ["k", "a\r\nb"]), (3, "RPUSH", ["l", "é", ""]), (3, "DEL", ["k"])]
    log = spark.createDataFrame([(1, "SET", ["a", "1"]), (2, "DEL", ["a"])], "seq long, cmd string, argv array<string>")
    resp.write_log(log, str(tmp_path / "out"))
    back = resp.read_log(spark, str(tmp_path / "out"))
    assert sorted((r.cmd, list(r.argv)) for r in back.collect()) == [("DEL", ["a"]), ("SET", ["a", "1"])]
    log = spark.createDataFrame([(i, i % 3, "SET", [f"k{i}", "v"]) for i in range(30)], "seq long, db int, cmd string, argv array<string>")
    resp.write_log(log, str(tmp_path / "dbs"))
    assert sorted((r.db, r.cmd, *r.argv) for r in resp.read_log(spark, str(tmp_path / "dbs")).collect()) == sorted((i % 3, "SET", f"k{i}", "v") for i in range(30))


def test_snapshot(spark, tmp_path):
    s = spark.createDataFrame([(0, "a", "1", None), (0, "b", "2", 5)], "db int, key string, value string, expire_at_ms long")
    z = spark.createDataFrame([(0, "a", "m", 1.0, None)], "db int, key string, member string, score double, expire_at_ms long")
    snapshot.save({"kv_string": s, "kv_zset": z}, str(tmp_path), as_of_ms=10)
    back = snapshot.load(spark, str(tmp_path), ["kv_string", "kv_zset"])
    assert [r.key for r in back["kv_string"].collect()] == ["a"]
    assert keyspace({"kv_string": s}).count() == 2 and type_conflicts({"kv_string": s, "kv_zset": z}).first().key == "a"


def test_catalogue(spark):
    assert len(rows()) == 190 and len({r[1] for r in rows()}) == 189 and len(dict(SETTINGS)) == len(SETTINGS) == 52
    assert catalogue(spark).filter("kind = 'write' and served").count() > 80


def test_live_group_windows_and_fan_out(spark, tmp_path):
    src = tmp_path / "in"
    schema = "key string, id_ms long, id_seq long, kind string"
    rows_ = [("s", 1000, 0, "entry"), ("s", 2000, 0, "entry"), ("s", 2000, 1, "entry"), ("t", 5, 0, "entry"), ("s", 1000, 0, "ack")]
    spark.createDataFrame(pd.DataFrame(rows_, columns=["key", "id_ms", "id_seq", "kind"]), schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = groups.consumer_group(stream, "g", ["c1", "c2"]).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.id_ms, r.id_seq, r.event): r.consumer for r in spark.sql("select * from live").collect()}
    assert got[("s", 1000, 0, "delivered")] == got[("s", 1000, 0, "acked")] == "c1" and got[("s", 2000, 0, "delivered")] == "c2" and len(got) == 5
    seen = []
    q = groups.replica(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert sum(seen) == 5
    subs = spark.createDataFrame([(1, "channel", "s")], "client_id long, kind string, name string")
    msgs = stream.select(F.col("id_ms").alias("seq"), F.col("key").alias("channel"))
    q = groups.fan_out(msgs, subs).writeStream.format("memory").queryName("out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination(120)
    assert spark.sql("select * from out").count() == 4
