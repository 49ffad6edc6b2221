"""The query catalogue: each operator applied to whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.log import fold, replay
from keyloom.operators import cluster, generic, geo, hashes, lists, pubsub, replication, scripting, server, sets, sketches, streams, strings, transactions, zsets
from keyloom.plans import commands
from keyloom.schema import visible
from keyloom.session import need_checkpoints
from keyloom.sources.adapters import Tables

NOW = 1704067500000
#: The relations of the adapters in SQL.
VIEWS = {
    "kv_string": "SELECT concat('cust:',c_custkey) AS key, c_name AS value, CASE WHEN c_custkey%4=0 THEN 1704067200000+c_custkey*1000 END AS expire_at_ms FROM customer",
    "live_string": f"SELECT * FROM kv_string WHERE expire_at_ms IS NULL OR expire_at_ms >= {NOW}",
    "kv_counter": "SELECT concat('bal:',c_custkey) AS key, CASE WHEN c_custkey%10=0 THEN 'n/a' ELSE CAST(CAST(round(c_acctbal*100) AS BIGINT) AS VARCHAR) END AS value, c_custkey AS id FROM customer",
    "kv_hash": "SELECT concat('cust:',c_custkey) AS key, 'name' AS field, c_name AS value, CAST(NULL AS BIGINT) AS fx, c_custkey AS id FROM customer UNION ALL SELECT concat('cust:',c_custkey), 'nation', CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey%3=0 THEN 1704067200000+c_custkey*1000 END, c_custkey FROM customer UNION ALL SELECT concat('cust:',c_custkey), 'cents', CAST(CAST(round(c_acctbal*100) AS BIGINT) AS VARCHAR), NULL, c_custkey FROM customer",
    "kv_list": "SELECT concat('ord:',l_orderkey) AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice)-1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_partkey AS VARCHAR) AS element, l_orderkey AS id FROM lineitem",
    "kv_zset": "SELECT concat('nat:',c_nationkey) AS key, c_name AS member, c_acctbal AS score FROM customer",
    "zranked": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member)-1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC)-1 AS rev, count(*) OVER (PARTITION BY key) AS n FROM kv_zset",
    "kv_set": "SELECT concat('seg:',c_mktsegment) AS key, CAST(c_custkey AS VARCHAR) AS member FROM customer UNION ALL SELECT concat('nat:',c_nationkey), CAST(c_custkey AS VARCHAR) FROM customer",
    "kv_stream": "SELECT concat('ev:',event_type) AS key, epoch_us(ts)//1000 AS id_ms, row_number() OVER (PARTITION BY event_type, epoch_us(ts)//1000 ORDER BY event_id)-1 AS id_seq, event_id, user_id, value FROM events",
    "points": "SELECT c_name AS member, (c_custkey*37%36000)/100.0::DOUBLE-180.0 AS lon, (c_custkey*53%17000)/100.0::DOUBLE-85.0 AS lat FROM customer",
    "keyspace": "SELECT 0 AS db, key, 'string' AS type, expire_at_ms FROM kv_string UNION ALL SELECT 0, concat('ord:',o_orderkey), 'list', NULL FROM orders UNION ALL SELECT 1, concat('nat:',n_nationkey), 'zset', NULL FROM nation",
    "live_keys": f"SELECT * FROM keyspace WHERE expire_at_ms IS NULL OR expire_at_ms >= {NOW}",
    "log": "SELECT event_id AS seq, epoch_us(ts)//1000 AS ts_ms, user_id AS client_id, CASE event_id%5 WHEN 0 THEN 'SET' WHEN 3 THEN 'DEL' ELSE 'INCRBY' END AS cmd, concat('u:',user_id) AS key, CAST(round(value*100) AS BIGINT) AS v FROM events",
    "pel": "SELECT key, 'g' AS grp, id_ms, id_seq, event_id, concat('c', user_id%3) AS consumer, id_ms+5 AS delivery_ms, 1 AS delivery_count FROM kv_stream",
}
_NEEDS = {"live_string": ["kv_string"], "zranked": ["kv_zset"], "live_keys": ["kv_string", "keyspace"], "keyspace": ["kv_string"], "pel": ["kv_stream"]}
_found: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def _with(sql: str) -> str:
    """The SQL with the views it names put before it."""
    import re

    need: list[str] = []

    def want(v: str) -> None:
        for w in _NEEDS.get(v, []):
            want(w)
        if v not in need:
            need.append(v)

    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            want(v)
    return ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in need) + " " if need else "") + sql


def query(name: str, sql: str | None):
    def put(f: Callable[[Tables], DataFrame]):
        _found[name] = (f, _with(sql) if sql else None)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: lambda spark, folder: f(Tables(spark, folder)))(f) for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _keys(t: Tables, prefix: str, step: int = 1) -> DataFrame:
    c = F.col("c_custkey")
    return t.table("customer").filter(c % step == 0).select(c.alias("ord"), F.concat(F.lit(prefix), c).alias("key"))


# Strings.
query("string_get", "SELECT k.c_custkey AS ord, s.value FROM customer k LEFT JOIN live_string s ON s.key=concat('cust:',k.c_custkey)")(lambda t: strings.get(t.strings(), _keys(t, "cust:"), NOW).select("ord", "value"))
query("string_mget", "SELECT k.c_custkey AS ord, s.value FROM customer k LEFT JOIN live_string s ON s.key=concat('cust:',k.c_custkey*2)")(lambda t: strings.get(t.strings(), t.table("customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("cust:"), F.col("c_custkey") * 2).alias("key")), NOW).select("ord", "value"))


def _new(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.table("customer").filter(c % 3 == 0).select(F.concat(F.lit("cust:"), c * 2).alias("key"), F.concat(F.lit("new"), c).alias("value"), F.lit(None).cast("long").alias("expire_at_ms"))


_NEW = "SELECT concat('cust:',c_custkey*2) AS key, concat('new',c_custkey) AS value FROM customer WHERE c_custkey%3=0"
query("string_set_upsert", f"SELECT key, value, expire_at_ms FROM live_string WHERE key NOT IN (SELECT key FROM ({_NEW})) UNION ALL SELECT key, value, NULL FROM ({_NEW})")(lambda t: strings.set_(t.strings(), _new(t), NOW))
query("string_set_nx", f"SELECT key, value, expire_at_ms FROM live_string UNION ALL SELECT key, value, NULL FROM ({_NEW}) WHERE key NOT IN (SELECT key FROM live_string)")(lambda t: strings.set_(t.strings(), _new(t), NOW, "nx"))
query("string_set_xx", f"SELECT s.key, coalesce(n.value,s.value) AS value, CASE WHEN n.key IS NULL THEN s.expire_at_ms END AS expire_at_ms FROM live_string s LEFT JOIN ({_NEW}) n ON n.key=s.key")(lambda t: strings.set_(t.strings(), _new(t), NOW, "xx"))
query("string_set_keepttl", f"SELECT coalesce(s.key,n.key) AS key, coalesce(n.value,s.value) AS value, s.expire_at_ms FROM live_string s FULL JOIN ({_NEW}) n ON n.key=s.key")(lambda t: strings.set_(t.strings(), _new(t), NOW, keep_ttl=True))
query("string_mset", "SELECT concat('u:',user_id) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")(lambda t: strings.set_(t.strings().limit(0), t.table("events").select(F.concat(F.lit("u:"), F.col("user_id")).alias("key"), F.col("event_type").alias("value"), F.lit(None).cast("long").alias("expire_at_ms"), F.col("event_id").alias("ord")), NOW).select("key", "value"))
query("string_msetnx", "SELECT key, value FROM live_string")(lambda t: strings.set_if_none(t.strings(), _new(t), NOW).select("key", "value"))


query("string_msetnx_none_there", "SELECT key, value FROM live_string UNION ALL SELECT concat('fresh:',c_custkey), c_name FROM customer")(
    lambda t: strings.set_if_none(t.strings(), t.table("customer").select(F.concat(F.lit("fresh:"), "c_custkey").alias("key"), F.col("c_name").alias("value"), F.lit(None).cast("long").alias("expire_at_ms")), NOW).select("key", "value")
)


def _delta(t: Tables, sign: int) -> DataFrame:
    return t.table("orders").select(F.concat(F.lit("bal:"), F.col("o_custkey")).alias("key"), (F.lit(sign) * F.col("o_orderkey")).alias("delta"))


def _incr(sign: int) -> str:
    return f"SELECT d.key, CASE WHEN c.value IS NULL OR c.value<>'n/a' THEN CAST(coalesce(TRY_CAST(c.value AS BIGINT),0)+d.delta AS VARCHAR) END AS value, CASE WHEN c.value='n/a' THEN 'value is not an integer or out of range' END AS error FROM (SELECT concat('bal:',o_custkey) AS key, CAST(sum({sign}*o_orderkey) AS BIGINT) AS delta FROM orders GROUP BY o_custkey) d LEFT JOIN kv_counter c USING (key)"


query("string_incrby", _incr(1))(lambda t: strings.increment(t.counters(), _delta(t, 1), NOW))
query("string_decrby", _incr(-1))(lambda t: strings.increment(t.counters(), _delta(t, -1), NOW))
query("string_incr", "SELECT key, CASE WHEN value<>'n/a' THEN CAST(TRY_CAST(value AS BIGINT)+1 AS VARCHAR) END AS value FROM kv_counter")(lambda t: strings.increment(t.counters(), _keys(t, "bal:").select("key", F.lit(1).alias("delta")), NOW).select("key", "value"))
query("string_decr", "SELECT key, CASE WHEN value<>'n/a' THEN CAST(TRY_CAST(value AS BIGINT)-1 AS VARCHAR) END AS value FROM kv_counter")(lambda t: strings.increment(t.counters(), _keys(t, "bal:").select("key", F.lit(-1).alias("delta")), NOW).select("key", "value"))
query("string_incrbyfloat", "SELECT key, TRY_CAST(value AS DOUBLE)+0.5 AS number FROM kv_counter")(lambda t: strings.increment_float(t.counters(), _keys(t, "bal:").select("key", F.lit(0.5).alias("delta")), NOW).select("key", "number"))
query("string_append", "SELECT concat('u:',user_id) AS key, string_agg(substr(event_type,1,1), '' ORDER BY event_id) AS value, count(*) AS length FROM events GROUP BY user_id")(lambda t: strings.append(t.strings(), t.table("events").select(F.concat(F.lit("u:"), F.col("user_id")).alias("key"), F.col("event_id").alias("ord"), F.substring("event_type", 1, 1).alias("tail")), NOW))
query("string_strlen", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS length FROM documents")(lambda t: strings.length(t.table("documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"), F.lit(None).cast("long").alias("expire_at_ms")), NOW).withColumnRenamed("key", "doc_id"))
query("string_getrange", "SELECT key, substr(value,6,4) AS part FROM live_string")(lambda t: strings.get_range(t.strings(), 5, 8, NOW))
query("string_getrange_neg", "SELECT key, right(value,4) AS part FROM live_string")(lambda t: strings.get_range(t.strings(), -4, -1, NOW))
query("string_setrange", "SELECT key, concat(substr(value,1,3),'XYZ',substr(value,7)) AS value FROM live_string")(lambda t: strings.set_range(t.strings(), 3, "XYZ", NOW))
query("string_getset", f"SELECT n.key, s.value AS old, n.value FROM ({_NEW}) n LEFT JOIN live_string s USING (key)")(lambda t: strings.get_set(t.strings(), _new(t), NOW))
query("string_getdel", "SELECT key, value FROM live_string WHERE TRY_CAST(substr(key,6) AS BIGINT)%5<>0")(lambda t: strings.get_delete(t.strings(), _keys(t, "cust:", 5), NOW)[1].select("key", "value"))
query("string_getex", f"SELECT key, value, CASE WHEN TRY_CAST(substr(key,6) AS BIGINT)%5=0 THEN {NOW}+60000 ELSE expire_at_ms END AS expire_at_ms FROM live_string")(lambda t: strings.get_expire(t.strings(), _keys(t, "cust:", 5), NOW, 60000))
query("string_setex", f"SELECT key, value, CASE WHEN n THEN {NOW}+5000 ELSE expire_at_ms END AS expire_at_ms FROM (SELECT key, value, expire_at_ms, false AS n FROM live_string WHERE key NOT IN (SELECT key FROM ({_NEW})) UNION ALL SELECT key, value, NULL, true FROM ({_NEW}))")(lambda t: strings.set_(t.strings(), _new(t).withColumn("expire_at_ms", F.lit(NOW + 5000)), NOW))
query("string_setnx", f"SELECT key, value FROM ({_NEW}) WHERE key NOT IN (SELECT key FROM live_string)")(lambda t: _new(t).join(strings.get(t.strings(), _new(t).select(F.lit(0).alias("ord"), "key"), NOW).filter("value is not null"), "key", "left_anti").select("key", "value"))
query("string_psetex", f"SELECT key, value, {NOW}+1500 AS expire_at_ms FROM ({_NEW})")(lambda t: strings.set_(t.strings().limit(0), _new(t).withColumn("expire_at_ms", F.lit(NOW + 1500)), NOW))

# Lists.
query("list_llen", "SELECT key, count(*) AS length FROM kv_list GROUP BY key")(lambda t: lists.length(t.lists()))
query("list_lrange", "SELECT key, i, element FROM kv_list WHERE i BETWEEN 1 AND 2")(lambda t: lists.range_(t.lists(), 1, 2))
query("list_lrange_neg", "SELECT key, i, element FROM kv_list WHERE i >= greatest(n-3,0) AND i <= n-2")(lambda t: lists.range_(t.lists(), -3, -2))
query("list_lindex", "SELECT key, element FROM kv_list WHERE i=n-1")(lambda t: lists.index(t.lists(), -1))


def _pushed(t: Tables) -> DataFrame:
    o = t.table("orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("ord:"), F.col("o_orderkey")).alias("key"))
    return o.select("key", F.posexplode(F.array(F.lit("p"), F.lit("q"))).alias("ord", "element"))


_PUSH = "SELECT key, i*2+100 AS o, element FROM kv_list UNION ALL SELECT concat('ord:',o_orderkey), {a}, 'p' FROM orders WHERE o_orderkey%2=0 UNION ALL SELECT concat('ord:',o_orderkey), {b}, 'q' FROM orders WHERE o_orderkey%2=0"
query("list_lpush", f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY o)-1 AS i, element FROM ({_PUSH.format(a=-1, b=-2)})")(lambda t: lists.dense(lists.push(t.lists(), _pushed(t), True)).select("key", "i", "element"))
query("list_rpush", f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY o)-1 AS i, element FROM ({_PUSH.format(a=100001, b=100002)})")(lambda t: lists.dense(lists.push(t.lists(), _pushed(t), False)).select("key", "i", "element"))
query("list_lpop", "SELECT key, i+1 AS ord, element FROM kv_list WHERE i<2")(lambda t: lists.pop(t.lists(), 2, True)[0])
query("list_rpop", "SELECT key, i, element FROM kv_list WHERE i<n-2")(lambda t: lists.dense(lists.pop(t.lists(), 2, False)[1]).select("key", "i", "element"))
query("list_blpop", "SELECT key, element FROM kv_list WHERE i=0")(lambda t: lists.pop(t.lists(), 1, True)[0].select("key", "element"))
query("list_brpop", "SELECT key, element FROM kv_list WHERE i=n-1")(lambda t: lists.pop(t.lists(), 1, False)[0].select("key", "element"))
query("list_lset", "SELECT key, i, CASE WHEN i=n-1 THEN 'Z' ELSE element END AS element FROM kv_list")(lambda t: lists.set_at(t.lists(), -1, "Z"))
_INS = "SELECT key, i*2.0 AS o, element FROM kv_list UNION ALL SELECT key, min(i)*2.0-1, 'new' FROM kv_list WHERE element='7' GROUP BY key"
query("list_linsert", f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY o)-1 AS i, element FROM ({_INS})")(lambda t: lists.insert(t.lists(), "7", "new", True))
query("list_lrem_head", "SELECT key, element FROM (SELECT key, element, row_number() OVER (PARTITION BY key, element ORDER BY i) AS r FROM kv_list) WHERE element<>'7' OR r>1")(lambda t: lists.remove(t.lists(), 1, "7").select("key", "element"))
query("list_lrem_tail", "SELECT key, i, element FROM (SELECT *, row_number() OVER (PARTITION BY key, element ORDER BY i DESC) AS r FROM kv_list) WHERE element<>'7' OR r>1")(lambda t: lists.remove(t.lists(), -1, "7").select("key", F.col("pos").alias("i"), "element"))
query("list_lrem_all", "SELECT key, i, element FROM kv_list WHERE element<>'7'")(lambda t: lists.remove(t.lists(), 0, "7").select("key", F.col("pos").alias("i"), "element"))
_MOVE = "SELECT CASE WHEN i=0 AND id%4=0 THEN concat('ord:',id+100000000) ELSE key END AS key, element FROM kv_list"
query("list_lmove", f"SELECT key, element FROM ({_MOVE})")(lambda t: lists.move(t.lists(), t.table("lineitem").filter("l_orderkey % 4 = 0").select(F.concat(F.lit("ord:"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("ord:"), F.col("l_orderkey") + 100000000).alias("target")).distinct(), True, False).select("key", "element"))
query("list_lmpop", "SELECT key, i+1 AS ord, element FROM kv_list WHERE id=(SELECT min(id) FROM kv_list) AND i<3")(lambda t: lists.pop_first(t.lists(), t.table("lineitem").select(F.col("l_orderkey").alias("ord"), F.concat(F.lit("ord:"), F.col("l_orderkey")).alias("key")).distinct(), 3, True))
query("list_blmpop", "SELECT key, n-i AS ord, element FROM kv_list WHERE id=(SELECT min(id) FROM kv_list) AND i>=n-2")(lambda t: lists.pop_first(t.lists(), t.table("lineitem").select(F.col("l_orderkey").alias("ord"), F.concat(F.lit("ord:"), F.col("l_orderkey")).alias("key")).distinct(), 2, False))
query("list_lpos", "SELECT key, min(i) AS i FROM kv_list WHERE element='7' GROUP BY key")(lambda t: lists.position(t.lists(), "7"))
query("list_lpos_rank_count", "SELECT key, i FROM (SELECT key, i, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS r FROM kv_list WHERE element='7' AND i>=n-3) WHERE r BETWEEN 1 AND 2")(lambda t: lists.position(t.lists(), "7", rank=-1, count=2, maxlen=3))

# Hashes.
query("hash_hget", "SELECT key, value FROM kv_hash WHERE field='name'")(lambda t: hashes.get(t.hashes(), "name"))


def _fields(t: Tables, *names: str) -> DataFrame:
    return t.table("customer").select(F.concat(F.lit("cust:"), F.col("c_custkey")).alias("key"), F.explode(F.array(*map(F.lit, names))).alias("field"))


_ASKED = "SELECT concat('cust:',c_custkey) AS key, unnest([{}]) AS field FROM customer"
query("hash_hmget", f"SELECT a.key, a.field, h.value FROM ({_ASKED.format(chr(39) + 'cents' + chr(39) + ',' + chr(39) + 'none' + chr(39))}) a LEFT JOIN kv_hash h USING (key, field)")(lambda t: hashes.multi_get(t.hashes(), _fields(t, "cents", "none").withColumn("ord", F.lit(0))).select("key", "field", "value"))


def _hnew(t: Tables) -> DataFrame:
    return t.table("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("cust:"), F.col("c_custkey")).alias("key"), F.explode(F.array(F.lit("name"), F.lit("vip"))).alias("field"), F.lit("x").alias("value"))


query("hash_hset", "SELECT key, field, CASE WHEN field='name' AND id%2=0 THEN 'x' ELSE value END AS value FROM kv_hash UNION ALL SELECT concat('cust:',c_custkey), 'vip', 'x' FROM customer WHERE c_custkey%2=0")(lambda t: hashes.set_(t.hashes(), _hnew(t)).select("key", "field", "value"))
query("hash_hmset_added", "SELECT concat('cust:',c_custkey) AS key, CAST(1 AS BIGINT) AS added FROM customer WHERE c_custkey%2=0")(lambda t: hashes.added(t.hashes(), _hnew(t)))
query("hash_hsetnx", "SELECT key, field, value FROM kv_hash UNION ALL SELECT concat('cust:',c_custkey), 'vip', 'x' FROM customer WHERE c_custkey%2=0")(lambda t: hashes.set_(t.hashes(), _hnew(t), only_new=True).select("key", "field", "value"))
query("hash_hdel", "SELECT key, field, value FROM kv_hash WHERE NOT (field='name' AND id%2=0)")(lambda t: hashes.delete(t.hashes(), _hnew(t)).select("key", "field", "value"))
query("hash_hexists", f"SELECT a.key, a.field, CASE WHEN h.key IS NULL THEN 0 ELSE 1 END AS found FROM ({_ASKED.format(chr(39) + 'name' + chr(39) + ',' + chr(39) + 'none' + chr(39))}) a LEFT JOIN kv_hash h USING (key, field)")(lambda t: hashes.exists(t.hashes(), _fields(t, "name", "none")))
query("hash_hlen", "SELECT key, count(*) AS length FROM kv_hash GROUP BY key")(lambda t: hashes.length(t.hashes()))
query("hash_hkeys", "SELECT key, field FROM kv_hash")(lambda t: hashes.fields(t.hashes()))
query("hash_hvals", "SELECT key, value FROM kv_hash")(lambda t: hashes.values(t.hashes()))
query("hash_hgetall", "SELECT key, field, value FROM kv_hash")(lambda t: hashes.all_(t.hashes()))
query("hash_hincrby", "SELECT key, 'cents' AS field, CAST(value AS BIGINT)+7 AS number FROM kv_hash WHERE field='cents'")(lambda t: hashes.increment(t.hashes(), _fields(t, "cents").withColumn("delta", F.lit(7).cast("long"))).select("key", "field", "number"))
query("hash_hincrbyfloat", "SELECT key, 'cents' AS field, CAST(value AS DOUBLE)+0.25 AS number FROM kv_hash WHERE field='cents'")(lambda t: hashes.increment_float(t.hashes(), _fields(t, "cents").withColumn("delta", F.lit(0.25))).select("key", "field", "number"))
query("hash_hscan_page", "SELECT key, field, value FROM kv_hash WHERE field IN ('name','nation')")(lambda t: hashes.page(t.hashes(), "cents", 2))
_HC = "CASE WHEN h.key IS NULL THEN -2 WHEN h.fx IS NOT NULL AND h.fx <= {at} THEN 0 ELSE 1 END"
query("hash_hexpire", f"SELECT a.key, a.field, CASE WHEN h.key IS NULL THEN -2 ELSE 1 END AS code FROM ({_ASKED.format(chr(39) + 'nation' + chr(39) + ',' + chr(39) + 'none' + chr(39))}) a LEFT JOIN kv_hash h USING (key, field)")(lambda t: hashes.expire(t.hashes(), _fields(t, "nation", "none"), NOW + 9000, NOW))
query("hash_hpexpire_nx", "SELECT key, field, CASE WHEN fx IS NULL THEN 1 ELSE 0 END AS code FROM kv_hash WHERE field='nation'")(lambda t: hashes.expire(t.hashes(), _fields(t, "nation"), NOW + 9000, NOW, "nx"))
query("hash_hexpireat_gt", f"SELECT key, field, value, CASE WHEN field='nation' AND (fx IS NULL OR fx < {NOW}+9000) THEN {NOW}+9000 ELSE fx END AS field_expire_at_ms FROM kv_hash")(lambda t: hashes.expired(t.hashes(), _fields(t, "nation"), NOW + 9000, NOW, "gt"))
query("hash_hpexpireat_past", "SELECT key, field, value FROM kv_hash WHERE field<>'nation'")(lambda t: hashes.expired(t.hashes(), _fields(t, "nation"), NOW - 1, NOW).select("key", "field", "value"))
for _n, _unit, _abs in (("hash_httl", 1000, False), ("hash_hpttl", 1, False), ("hash_hexpiretime", 1000, True), ("hash_hpexpiretime", 1, True)):
    query(_n, f"SELECT key, field, CAST(CASE WHEN fx < {NOW} THEN -2 WHEN fx IS NULL THEN -1 ELSE {'fx' if _abs else f'(fx-{NOW})'}//{_unit} END AS BIGINT) AS ttl FROM kv_hash WHERE field IN ('nation','name')")((lambda u, a: lambda t: hashes.ttl(t.hashes(), _fields(t, "nation", "name"), NOW, u, a))(_unit, _abs))
query("hash_hpersist", "SELECT key, field, CASE WHEN fx IS NULL THEN -1 ELSE 1 END AS code FROM kv_hash WHERE field IN ('nation','name')")(lambda t: hashes.persist(t.hashes(), _fields(t, "nation", "name")))
query("hash_hrandfield", "SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat('11:',field)), field) AS r FROM kv_hash) WHERE r<=2")(lambda t: hashes.random_fields(t.hashes(), 2, 11))

# Sets.
_NATS = [f"nat:{i}" for i in range(5)]
_IN = "'" + "','".join(_NATS) + "'"


def _snew(t: Tables) -> DataFrame:
    return t.table("supplier").select(F.concat(F.lit("nat:"), F.col("s_nationkey")).alias("key"), F.col("s_suppkey").cast("string").alias("member"))


_SNEW = "SELECT concat('nat:',s_nationkey) AS key, CAST(s_suppkey AS VARCHAR) AS member FROM supplier"
query("set_sadd", f"SELECT DISTINCT key, member FROM (SELECT * FROM kv_set UNION ALL {_SNEW})")(lambda t: sets.add(t.sets(), _snew(t)))
query("set_sadd_added", f"SELECT key, count(*) AS added FROM (SELECT DISTINCT * FROM ({_SNEW}) EXCEPT SELECT * FROM kv_set) GROUP BY key")(lambda t: sets.added(t.sets(), _snew(t)))
query("set_srem", f"SELECT key, member FROM kv_set EXCEPT SELECT key, member FROM ({_SNEW})")(lambda t: sets.remove(t.sets(), _snew(t)))
query("set_smembers", "SELECT member FROM kv_set WHERE key='seg:BUILDING'")(lambda t: sets.members(t.sets(), "seg:BUILDING"))
query("set_sismember", f"SELECT a.key, a.member, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS found FROM ({_SNEW}) a LEFT JOIN kv_set s USING (key, member)")(lambda t: sets.is_member(t.sets(), _snew(t)))
query("set_smismember", "SELECT 'seg:BUILDING' AS key, CAST(c_custkey AS VARCHAR) AS member, CASE WHEN c_mktsegment='BUILDING' THEN 1 ELSE 0 END AS found FROM customer")(lambda t: sets.is_member(t.sets(), t.table("customer").select(F.lit("seg:BUILDING").alias("key"), F.col("c_custkey").cast("string").alias("member"))))
query("set_scard", "SELECT key, count(*) AS card FROM kv_set GROUP BY key")(lambda t: sets.card(t.sets()))
query("set_sinter", "SELECT member FROM kv_set WHERE key='seg:BUILDING' INTERSECT SELECT member FROM kv_set WHERE key='nat:3'")(lambda t: sets.inter(t.sets(), ["seg:BUILDING", "nat:3"]))
query("set_sunion", f"SELECT DISTINCT member FROM kv_set WHERE key IN ({_IN})")(lambda t: sets.union(t.sets(), _NATS))
query("set_sdiff", f"SELECT member FROM kv_set WHERE key='seg:BUILDING' EXCEPT SELECT member FROM kv_set WHERE key IN ({_IN})")(lambda t: sets.diff(t.sets(), ["seg:BUILDING", *_NATS]))
query("set_sintercard", "SELECT least(count(*),3) AS card FROM (SELECT member FROM kv_set WHERE key='seg:BUILDING' INTERSECT SELECT member FROM kv_set WHERE key='nat:3')")(lambda t: sets.inter_card(t.sets(), ["seg:BUILDING", "nat:3"], 3))
_ST = "SELECT key, member FROM kv_set WHERE key<>'dst' UNION ALL SELECT 'dst', member FROM ({})"
query("set_sinterstore", _ST.format("SELECT member FROM kv_set WHERE key='seg:BUILDING' INTERSECT SELECT member FROM kv_set WHERE key='nat:3'"))(lambda t: sets.store(t.sets(), "dst", sets.inter(t.sets(), ["seg:BUILDING", "nat:3"])))
query("set_sunionstore", _ST.format(f"SELECT DISTINCT member FROM kv_set WHERE key IN ({_IN})"))(lambda t: sets.store(t.sets(), "dst", sets.union(t.sets(), _NATS)))
query("set_sdiffstore", _ST.format(f"SELECT member FROM kv_set WHERE key='seg:BUILDING' EXCEPT SELECT member FROM kv_set WHERE key IN ({_IN})"))(lambda t: sets.store(t.sets(), "dst", sets.diff(t.sets(), ["seg:BUILDING", *_NATS])))
query("set_smove", "SELECT DISTINCT CASE WHEN key='seg:BUILDING' AND member=(SELECT min(member) FROM kv_set) THEN 'seg:MACHINERY' ELSE key END AS key, member FROM kv_set")(lambda t: sets.move(t.sets(), "seg:BUILDING", "seg:MACHINERY", t.sets().agg(F.min("member")).first()[0]))
query("set_sscan_page", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r FROM kv_set WHERE member>'5') WHERE r<=4")(lambda t: sets.page(t.sets(), "5", 4))
query("set_srandmember", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat('5:',member)), member) AS r FROM kv_set) WHERE r<=3")(lambda t: sets.random_members(t.sets(), 3, 5))
query("set_spop", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat('5:',member)), member) AS r FROM kv_set) WHERE r>3")(lambda t: sets.pop(t.sets(), 3, 5)[1])

# Sorted sets.
query("leaderboard", "SELECT key, member, score, rev AS rank FROM zranked WHERE rev<3")(lambda t: zsets.top(t.zsets(), 3, reverse=True))


def _znew(t: Tables) -> DataFrame:
    return t.table("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("nat:"), F.col("c_nationkey")).alias("key"), F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("+"))).otherwise(F.col("c_name")).alias("member"), F.lit(500.0).alias("score"))


_ZN = "SELECT concat('nat:',c_nationkey) AS key, CASE WHEN c_custkey%4=0 THEN concat(c_name,'+') ELSE c_name END AS member, CAST(500.0 AS DOUBLE) AS score FROM customer WHERE c_custkey%2=0"
_ZJ = f"SELECT coalesce(z.key,n.key) AS key, coalesce(z.member,n.member) AS member, {{}} AS score FROM kv_zset z {{}} JOIN ({_ZN}) n ON n.key=z.key AND n.member=z.member"
query("zset_zadd", _ZJ.format("coalesce(n.score,z.score)", "FULL"))(lambda t: zsets.add(t.zsets(), _znew(t)))
query("zset_zadd_nx", _ZJ.format("coalesce(z.score,n.score)", "FULL"))(lambda t: zsets.add(t.zsets(), _znew(t), only="nx"))
query("zset_zadd_xx", _ZJ.format("coalesce(n.score,z.score)", "LEFT"))(lambda t: zsets.add(t.zsets(), _znew(t), only="xx"))
query("zset_zadd_gt", _ZJ.format("greatest(z.score,n.score)", "FULL"))(lambda t: zsets.add(t.zsets(), _znew(t), better="gt"))
query("zset_zadd_lt", _ZJ.format("least(z.score,n.score)", "FULL"))(lambda t: zsets.add(t.zsets(), _znew(t), better="lt"))
query("zset_zincrby", _ZJ.format("coalesce(z.score,0)+coalesce(n.score,0)", "FULL"))(lambda t: zsets.increment(t.zsets(), _znew(t)))
query("zset_zcard", "SELECT key, count(*) AS card FROM kv_zset GROUP BY key")(lambda t: zsets.card(t.zsets()))
query("zset_zscore", "SELECT key, member, score FROM kv_zset")(lambda t: zsets.score(t.zsets(), t.zsets().select(F.lit(0).alias("ord"), "key", "member")).drop("ord"))
query("zset_zmscore", f"SELECT n.key, n.member, z.score FROM ({_ZN}) n LEFT JOIN kv_zset z USING (key, member)")(lambda t: zsets.score(t.zsets(), _znew(t).select(F.lit(0).alias("ord"), "key", "member")).drop("ord"))
query("zset_zrank", f"SELECT key, member, score, rank FROM zranked SEMI JOIN ({_ZN}) n USING (key, member)")(lambda t: zsets.rank(t.zsets(), _znew(t)))
query("zset_zrevrank", f"SELECT key, member, score, rev AS rank FROM zranked SEMI JOIN ({_ZN}) n USING (key, member)")(lambda t: zsets.rank(t.zsets(), _znew(t), reverse=True))
query("zset_zrange", "SELECT key, member, score, rank FROM zranked WHERE rank BETWEEN 2 AND 5")(lambda t: zsets.range_(t.zsets(), 2, 5))
query("zset_zrange_neg", "SELECT key, member, score, rank FROM zranked WHERE rank>=greatest(n-3,0) AND rank<=n-1")(lambda t: zsets.range_(t.zsets(), -3, -1))
query("zset_zrevrange", "SELECT key, member, score, rev AS rank FROM zranked WHERE rev BETWEEN 1 AND 4")(lambda t: zsets.range_(t.zsets(), 1, 4, reverse=True))
query("zset_zrangebyscore", "SELECT key, member, score FROM kv_zset WHERE score>100 AND score<=900")(lambda t: zsets.range_by_score(t.zsets(), 100, 900, low_open=True))
query("zset_zrevrangebyscore", "SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC)-1 AS rank FROM kv_zset WHERE score BETWEEN 100 AND 900")(lambda t: zsets.ranked(zsets.range_by_score(t.zsets(), 100, 900), reverse=True))
query("zset_zrangebylex", "SELECT key, member, score FROM kv_zset WHERE member>='Customer#000000100' AND member<'Customer#000000500'")(lambda t: zsets.range_by_lex(t.zsets(), "[Customer#000000100", "(Customer#000000500"))
query("zset_zrevrangebylex", "SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member DESC)-1 AS rank FROM kv_zset WHERE member>'Customer#000000100'")(lambda t: zsets.ranked(zsets.range_by_lex(t.zsets(), "(Customer#000000100", "+").withColumn("score", F.lit(0.0)), reverse=True).select("key", "member", "rank"))
query("zset_zcount", "SELECT key, count(*) FILTER (WHERE score BETWEEN 100 AND 900) AS n FROM kv_zset GROUP BY key")(lambda t: zsets.count(t.zsets(), 100, 900))
query("zset_zrem", f"SELECT key, member, score FROM kv_zset ANTI JOIN ({_ZN}) n USING (key, member)")(lambda t: zsets.remove(t.zsets(), _znew(t)))
query("zset_zremrangebyscore", "SELECT key, member, score FROM kv_zset WHERE NOT score BETWEEN 100 AND 900")(lambda t: zsets.remove_by_score(t.zsets(), 100, 900))
query("zset_zremrangebyrank", "SELECT key, member, score FROM zranked WHERE rank<n-2")(lambda t: zsets.remove_by_rank(t.zsets(), -2, -1))
query("zset_zremrangebylex", "SELECT key, member, score FROM kv_zset WHERE NOT member<='Customer#000000500'")(lambda t: zsets.remove_by_lex(t.zsets(), "-", "[Customer#000000500"))
query("zset_zpopmin", "SELECT key, member, score FROM zranked WHERE rank<2")(lambda t: zsets.pop(t.zsets(), 2)[0])
query("zset_zpopmax", "SELECT key, member, score FROM zranked WHERE rev>=2")(lambda t: zsets.pop(t.zsets(), 2, largest=True)[1])
query("zset_zmpop", "SELECT key, member, score, rank FROM zranked WHERE key='nat:1' AND rank<3")(lambda t: zsets.pop_first(t.zsets(), t.table("nation").filter("n_nationkey > 0").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("nat:"), F.col("n_nationkey")).alias("key")), 3))
query("zset_bzmpop", "SELECT key, member, score, rev AS rank FROM zranked WHERE key='nat:0' AND rev<2")(lambda t: zsets.pop_first(t.zsets(), t.table("nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("nat:"), F.col("n_nationkey")).alias("key")), 2, True))


def _zseg(t: Tables) -> DataFrame:
    return t.table("orders").select(F.concat(F.lit("pri:"), F.substring("o_orderpriority", 1, 1)).alias("key"), F.col("o_custkey").cast("string").alias("member"), F.col("o_orderkey").cast("double").alias("score")).groupBy("key", "member").agg(F.sum("score").alias("score"))


_ZS = "SELECT concat('pri:',substr(o_orderpriority,1,1)) AS key, CAST(o_custkey AS VARCHAR) AS member, sum(CAST(o_orderkey AS DOUBLE)) AS score FROM orders GROUP BY 1,2"
query("zset_zunionstore", f"SELECT member, sum(score) AS score FROM ({_ZS}) WHERE key IN ('pri:1','pri:2') GROUP BY member")(lambda t: zsets.combine(_zseg(t), ["pri:1", "pri:2"], every=False))
query("zset_zinterstore", f"SELECT member, sum(score) AS score FROM ({_ZS}) WHERE key IN ('pri:1','pri:2') GROUP BY member HAVING count(*)=2")(lambda t: zsets.combine(_zseg(t), ["pri:1", "pri:2"], every=True))
query("zset_zunion_weights", f"SELECT member, max(CASE key WHEN 'pri:1' THEN score*2 ELSE score*3 END) AS score FROM ({_ZS}) WHERE key IN ('pri:1','pri:2') GROUP BY member")(lambda t: zsets.combine(_zseg(t), ["pri:1", "pri:2"], False, [2.0, 3.0], "max"))
query("zset_zdiff", f"SELECT member, score FROM ({_ZS}) a WHERE key='pri:1' AND member NOT IN (SELECT member FROM ({_ZS}) WHERE key='pri:2')")(lambda t: zsets.difference(_zseg(t), ["pri:1", "pri:2"]))
query("zset_zrangestore", "SELECT 'dst' AS key, member, score FROM zranked WHERE key='nat:1' AND rank BETWEEN 1 AND 3")(lambda t: zsets.store(t.zsets(), "dst", zsets.range_(t.zsets().filter("key = 'nat:1'"), 1, 3)).filter("key = 'dst'"))
query("zset_zscan_page", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM kv_zset WHERE score>100) WHERE r<=5")(lambda t: zsets.page(t.zsets(), (100.0, "~"), 5))
query("zset_zrandmember", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat('9:',member)), member) AS r FROM kv_zset) WHERE r<=2")(lambda t: zsets.random_members(t.zsets(), 2, 9))

# Keys of any type.
query("key_exists", "SELECT count(*) AS found FROM customer c JOIN (SELECT DISTINCT key FROM live_keys) k ON k.key=concat('cust:',c.c_custkey)")(lambda t: generic.exists(t.keyspace(), _keys(t, "cust:"), NOW))
query("key_touch", "SELECT count(*) AS found FROM orders o JOIN (SELECT DISTINCT key FROM live_keys) k ON k.key=concat('ord:',o.o_orderkey)")(lambda t: generic.exists(t.keyspace(), t.table("orders").select(F.concat(F.lit("ord:"), F.col("o_orderkey")).alias("key")), NOW))
query("key_type", "SELECT concat('cust:',c_custkey) AS key, coalesce(k.type,'none') AS type FROM customer c LEFT JOIN live_keys k ON k.key=concat('cust:',c.c_custkey)")(lambda t: generic.type_(t.keyspace(), _keys(t, "cust:"), NOW))
query("key_keys_glob", "SELECT key FROM live_keys WHERE regexp_matches(key, '^cust:.[02-5].*$')")(lambda t: generic.keys(t.keyspace(), "cust:?[02-5]*", NOW))
query("key_scan_page", "SELECT key FROM (SELECT key FROM live_keys WHERE key>'cust:5' ORDER BY key LIMIT 200) WHERE key LIKE '%7'")(lambda t: generic.scan(t.keyspace(), "cust:5", 200, NOW, "*7"))
query("key_del", "SELECT key, type FROM keyspace WHERE NOT (key LIKE 'cust:%' AND TRY_CAST(substr(key,6) AS BIGINT)%5=0)")(lambda t: generic.delete(t.keyspace(), _keys(t, "cust:", 5)).select("key", "type"))
query("key_unlink", "SELECT key FROM keyspace WHERE key NOT LIKE 'ord:%'")(lambda t: generic.delete(t.keyspace(), t.table("orders").select(F.concat(F.lit("ord:"), F.col("o_orderkey")).alias("key"))).select("key"))
query("key_rename", "SELECT CASE WHEN key='cust:1' THEN 'cust:2' ELSE key END AS key, value, expire_at_ms FROM kv_string WHERE key<>'cust:2'")(lambda t: generic.rename(t.strings(), "cust:1", "cust:2"))
query("key_renamenx", "SELECT key, value FROM kv_string")(lambda t: generic.rename(t.strings(), "cust:1", "cust:2", only_new=True).select("key", "value"))
query("key_copy", "SELECT key, value, expire_at_ms FROM kv_string UNION ALL SELECT 'copy:4', value, NULL FROM kv_string WHERE key='cust:4'")(lambda t: generic.copy(t.strings(), "cust:4", "copy:4"))
query("key_move", "SELECT CASE WHEN db=0 AND type='list' THEN 1 ELSE db END AS db, key FROM keyspace")(lambda t: generic.move(t.keyspace(), t.keyspace().filter("type = 'list'").select("db", "key"), 1).select("db", "key"))
for _n, _at in (("key_expire", NOW + 60000), ("key_pexpire", NOW + 60), ("key_expireat", 1704070000000), ("key_pexpireat", 1704070000001)):
    query(_n, f"SELECT key, CASE WHEN key LIKE 'cust:%' AND TRY_CAST(substr(key,6) AS BIGINT)%5=0 THEN {_at} ELSE expire_at_ms END AS expire_at_ms FROM live_keys")((lambda at: lambda t: generic.expire(t.keyspace(), _keys(t, "cust:", 5), at, NOW).select("key", "expire_at_ms"))(_at))
query("key_persist", "SELECT key, CASE WHEN NOT (key LIKE 'cust:%' AND TRY_CAST(substr(key,6) AS BIGINT)%5=0) THEN expire_at_ms END AS expire_at_ms FROM live_keys")(lambda t: generic.expire(t.keyspace(), _keys(t, "cust:", 5), None, NOW).select("key", "expire_at_ms"))
for _n, _unit, _abs in (("key_ttl", 1000, False), ("key_pttl", 1, False), ("key_expiretime", 1000, True), ("key_pexpiretime", 1, True)):
    query(_n, f"SELECT concat('cust:',c_custkey) AS key, CAST(CASE WHEN k.key IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE {'expire_at_ms' if _abs else f'(expire_at_ms-{NOW})'}//{_unit} END AS BIGINT) AS ttl FROM customer LEFT JOIN live_keys k ON k.key=concat('cust:',c_custkey)")((lambda u, a: lambda t: generic.ttl(t.keyspace(), _keys(t, "cust:"), NOW, u, a))(_unit, _abs))
query("key_dbsize", f"SELECT db, count(*) AS raw, count(*) FILTER (WHERE expire_at_ms IS NULL OR expire_at_ms>={NOW}) AS live FROM keyspace GROUP BY db")(lambda t: generic.db_size(t.keyspace(), NOW))
query("key_select", "SELECT key FROM keyspace WHERE db=1")(lambda t: t.keyspace().filter("db = 1").select("key"))
query("key_flushdb", "SELECT db, key FROM keyspace WHERE db<>1")(lambda t: generic.flush_db(t.keyspace(), 1).select("db", "key"))
query("key_flushall", "SELECT db, key FROM keyspace WHERE false")(lambda t: t.keyspace().limit(0).select("db", "key"))
query("key_randomkey", "SELECT key FROM live_keys ORDER BY md5(concat('3:',key)), key LIMIT 1")(lambda t: generic.random_key(t.keyspace(), NOW, 3))
query("key_active_expire", "SELECT key FROM live_keys")(lambda t: generic.compact(t.keyspace(), NOW).select("key"))
query("key_object_encoding", "SELECT doc_id, CASE WHEN strlen(text)<=44 THEN 'embstr' ELSE 'raw' END AS encoding FROM documents WHERE NOT regexp_full_match(text,'[+-]?[0-9]+')")(lambda t: generic.encoding(t.table("documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value")), "string").filter("encoding <> 'int'").withColumnRenamed("key", "doc_id"))
query("key_object_encoding_set", "SELECT key, CASE WHEN count(*)<=512 THEN 'intset' ELSE 'hashtable' END AS encoding FROM kv_set GROUP BY key")(lambda t: generic.encoding(t.sets(), "set"))
query("key_object_encoding_zset", "SELECT key, CASE WHEN count(*)<=128 AND max(strlen(member))<=64 THEN 'listpack' ELSE 'skiplist' END AS encoding FROM kv_zset GROUP BY key")(lambda t: generic.encoding(t.zsets(), "zset"))
query("key_object_encoding_list", "SELECT key, CASE WHEN count(*)<=128 THEN 'listpack' ELSE 'quicklist' END AS encoding FROM kv_list GROUP BY key")(lambda t: generic.encoding(t.lists(), "list"))
query("memory_usage", "SELECT key, CAST(64+sum(strlen(field)+strlen(value)) AS BIGINT) AS bytes FROM kv_hash GROUP BY key")(lambda t: generic.memory_usage(t.hashes(), ["field", "value"]))

# Geo.
_LON, _LAT = "floor((lon+180.0)/360.0*67108864)/67108864*360.0-180.0", "floor((lat+90.0)/180.0*67108864)/67108864*180.0-90.0"
_HAV = "2*6372797.560856*asin(sqrt(least(pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2),1.0)))"
_CELLS = f"SELECT member, {_LON} AS lon, {_LAT} AS lat FROM points"
_CELL = "CAST(list_sum(list_transform(range(26), lambda b: ((CAST(floor((lon+180.0)/360.0*67108864) AS BIGINT)>>b)&1)*(CAST(1 AS BIGINT)<<(2*b)) + ((CAST(floor((lat+90.0)/180.0*67108864) AS BIGINT)>>b)&1)*(CAST(1 AS BIGINT)<<(2*b+1)))) AS BIGINT)"
query("geo_geoadd_hash", f"SELECT member, {_CELL} AS cell FROM points")(lambda t: geo.add(t.points()).select("member", F.col("score").cast("long").alias("cell")))
query("geo_geopos", f"SELECT member, round(lon,6) AS lon, round(lat,6) AS lat FROM ({_CELLS})")(lambda t: geo.position(geo.add(t.points())).select("member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")))


def _pairs(t: Tables) -> DataFrame:
    p = t.points().select("key", "member")
    return t.table("customer").select(F.lit("geo").alias("key"), F.col("c_name").alias("a"), (F.col("c_custkey") + 1).alias("n")).join(t.table("customer").select(F.col("c_custkey").alias("n"), F.col("c_name").alias("b")), "n").select("key", "a", "b").join(p.select("key", F.col("member").alias("a")), ["key", "a"], "left_semi")


query("geo_geodist", f"WITH c AS ({_CELLS.replace('points', '(' + VIEWS['points'] + ')')}) SELECT x.c_name AS a, y.c_name AS b, round({_HAV.format(lat1='p.lat', lon1='p.lon', lat2='q.lat', lon2='q.lon')}/1000.0,3) AS km FROM customer x JOIN customer y ON y.c_custkey=x.c_custkey+1 JOIN c p ON p.member=x.c_name JOIN c q ON q.member=y.c_name")(lambda t: geo.distance(geo.add(t.points()), _pairs(t), "m").select("a", "b", F.round(F.col("distance") / 1000.0, 3).alias("km")))
query("geo_geohash", f"SELECT 'geo' AS key, member, array_to_string(list_transform(range(11), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1+((cell>>CAST(5*i AS INTEGER))&31) AS INTEGER), 1)), '') AS hash FROM (SELECT member, {_CELL} AS cell FROM points)")(lambda t: geo.hash_text(geo.add(t.points())))
_DIST = _HAV.format(lat1="lat", lon1="lon", lat2="10.0", lon2="20.0")
query("geo_search_radius", f"SELECT member, round({_DIST},3) AS metres FROM ({_CELLS}) WHERE {_DIST}<=5000000")(lambda t: geo.search(geo.add(t.points()), 20.0, 10.0, 5000, "km").select("member", F.round("metres", 3).alias("metres")))
query("geo_search_box", f"SELECT member, round({_DIST},3) AS metres FROM ({_CELLS}) WHERE {_DIST}<=1500000")(lambda t: geo.search_box(geo.add(t.points()), 20.0, 10.0, 3000, 2000, "km").select("member", F.round("metres", 3).alias("metres")))
_SIDES = "lat AS la, lon AS lo, " + _HAV.format(lat1="lat", lon1="lon", lat2="lat", lon2="20.0") + " AS x, " + _HAV.format(lat1="lat", lon1="20.0", lat2="10.0", lon2="20.0") + " AS y"
query("geo_search_true_box", f"SELECT member, round({_DIST},3) AS metres FROM (SELECT *, {_SIDES} FROM ({_CELLS})) WHERE x<=3000000 AND y<=1000000")(
    lambda t: geo.search_box(geo.add(t.points()), 20.0, 10.0, 6000, 2000, "km", true_box=True).select("member", F.round("metres", 3).alias("metres"))
)
query("geo_searchstore", f"SELECT 'near' AS key, member FROM ({_CELLS}) WHERE {_DIST}<=5000000")(lambda t: geo.search_store(geo.add(t.points()), "near", geo.search(geo.add(t.points()), 20.0, 10.0, 5000, "km")).filter("key = 'near'").select("key", "member"))

# Sketches: the estimate's error is the result.
_elements = lambda t: t.table("events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("element"))
query("hll_pfcount_bound", "SELECT event_type AS key, true AS ok FROM events GROUP BY event_type")(lambda t: sketches.count(sketches.add(_elements(t))).join(_elements(t).groupBy("key").agg(F.count_distinct("element").alias("n")), "key").select("key", (F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(2.0), 0.05 * F.col("n"))).alias("ok")))
query("hll_pfmerge_bound", "SELECT 'all' AS key, true AS ok")(lambda t: sketches.count(sketches.merge(sketches.add(_elements(t)), "all")).crossJoin(F.broadcast(_elements(t).agg(F.count_distinct("element").alias("n")))).select("key", (F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(2.0), 0.05 * F.col("n"))).alias("ok")))
query("hll_pfadd_bound", "SELECT event_type AS key, true AS ok FROM events GROUP BY event_type")(lambda t: sketches.add(_elements(t)).select("key", F.col("sketch").isNotNull().alias("ok")))

# Streams.
_SC = "key, id_ms, id_seq, event_id"
_cut = lambda df: df.select("key", "id_ms", "id_seq", "event_id")
_LO, _HI = 1704067200000 + 6 * 3600 * 1000, 1704067200000 + 30 * 24 * 3600 * 1000
query("stream_xadd", f"SELECT {_SC} FROM kv_stream")(lambda t: _cut(streams.add(t.stream().drop("id_seq").withColumn("ord", F.col("event_id")))))
query("stream_xlen", "SELECT key, count(*) AS length FROM kv_stream GROUP BY key")(lambda t: streams.length(t.stream()))
query("stream_xrange", f"SELECT {_SC} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms,id_seq) AS r FROM kv_stream WHERE id_ms>={_LO} AND (id_ms<{_HI} OR (id_ms={_HI} AND id_seq=0))) WHERE r<=20")(lambda t: _cut(streams.range_(t.stream(), (_LO, 0), (_HI, 0), 20)))
query("stream_xrevrange", f"SELECT {_SC} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms DESC,id_seq DESC) AS r FROM kv_stream WHERE id_ms>={_LO} AND (id_ms<{_HI} OR (id_ms={_HI} AND id_seq=0))) WHERE r<=7")(lambda t: _cut(streams.range_(t.stream(), (_LO, 0), (_HI, 0), 7, reverse=True)))
_cursor = lambda t: streams.range_(t.stream(), (0, 0), (2**62, 0), 5).groupBy("key").agg(F.max(F.struct("id_ms", "id_seq")).alias("x")).select("key", F.col("x.id_ms").alias("last_ms"), F.col("x.id_seq").alias("last_seq"))
query("stream_xread", f"SELECT {_SC} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms,id_seq) AS r FROM kv_stream) WHERE r BETWEEN 6 AND 15")(lambda t: _cut(streams.read(t.stream(), _cursor(t), 10)))
query("stream_xdel", f"SELECT {_SC} FROM kv_stream WHERE event_id%3<>0")(lambda t: _cut(streams.delete(t.stream(), t.stream().filter("event_id % 3 = 0"))))
query("stream_xtrim", f"SELECT {_SC} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms DESC,id_seq DESC) AS r FROM kv_stream) WHERE r<=50")(lambda t: _cut(streams.trim(t.stream(), 50)))
_groups = lambda t: t.stream().select("key").distinct().select("key", F.lit("g").alias("grp"), F.lit(_LO).alias("last_ms"), F.lit(0).cast("long").alias("last_seq"))
_GR = f"SELECT DISTINCT key, 'g' AS grp, {_LO} AS last_ms, CAST(0 AS BIGINT) AS last_seq FROM kv_stream"
query("stream_group_create", _GR)(lambda t: streams.group_create(_groups(t).limit(0), _groups(t)))
query("stream_group_setid", "SELECT DISTINCT key, CASE WHEN key='ev:click' THEN 5 ELSE " + str(_LO) + " END AS last_ms FROM kv_stream")(lambda t: streams.group_set_id(_groups(t), "ev:click", "g", (5, 0)).select("key", F.col("last_ms").cast("long").alias("last_ms")))
query("stream_group_destroy", "SELECT DISTINCT key, 'g' AS grp FROM kv_stream WHERE key<>'ev:click'")(lambda t: streams.group_destroy(_groups(t), _groups(t).filter("key = 'ev:click'")).select("key", "grp"))
_RG = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms,id_seq) AS r FROM kv_stream WHERE id_ms>{_LO} OR (id_ms={_LO} AND id_seq>0)"
query("stream_readgroup", f"SELECT {_SC} FROM ({_RG}) WHERE r<=12")(lambda t: _cut(streams.group_read(t.stream(), _groups(t), "c1", NOW, 12)[0]))
query("stream_readgroup_cursor", f"SELECT key, id_ms AS last_ms, id_seq AS last_seq FROM ({_RG}) WHERE r=12")(lambda t: streams.group_read(t.stream(), _groups(t), "c1", NOW, 12)[2].select("key", "last_ms", "last_seq"))
_CLAIM_AT = 1704067200000 + 20 * 24 * 3600 * 1000
query("stream_xinfo", "SELECT key, count(*) AS length, min(id_ms) AS first_ms, max(id_ms) AS last_ms FROM kv_stream GROUP BY key")(lambda t: streams.info(t.stream()).select("key", "length", "first_ms", "last_ms"))
query("stream_window_tumbling", "SELECT key, id_ms//3600000*3600000 AS window_ms, count(*) AS n FROM kv_stream GROUP BY 1,2")(lambda t: streams.tumbling(t.stream(), 3600000))
query("stream_window_session", "SELECT key, min(id_ms) AS start_ms, max(id_ms) AS end_ms, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY id_ms,id_seq) AS part FROM (SELECT *, CASE WHEN id_ms-lag(id_ms) OVER (PARTITION BY key ORDER BY id_ms,id_seq)<=600000 THEN 0 ELSE 1 END AS s FROM kv_stream)) GROUP BY key, part")(lambda t: streams.sessions(t.stream(), 600000))
query("stream_rejected", "SELECT event_id FROM (SELECT event_id, struct_pack(a:=epoch_us(ts)//1000, b:=0) AS id, max(struct_pack(a:=epoch_us(ts)//1000, b:=0)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE id<=before")(lambda t: streams.rejected(t.stream().withColumns({"ord": F.col("event_id"), "id_seq": F.lit(0).cast("long")})).select("event_id"))

# Publish and subscribe.
_msgs = lambda t: t.table("events").select(F.col("event_id").alias("seq"), F.concat(F.lit("ev."), F.col("event_type")).alias("channel"))
query("pubsub_publish_pattern", "SELECT event_id AS seq, client_id FROM events JOIN (SELECT 1 AS client_id, '^ev\\.c.*$' AS re UNION ALL SELECT 2, '^ev\\.[pv].*$') p ON regexp_matches(concat('ev.',event_type), re)")(lambda t: pubsub.deliver_patterns(_msgs(t), pubsub.with_regex(t.spark, [(1, "ev.c*"), (2, "ev.[pv]*")])).select("seq", F.col("client_id").cast("int").alias("client_id")))

# Transactions and the log.


def _txn_log(t: Tables) -> DataFrame:
    cmd = F.element_at(F.array(*map(F.lit, ("MULTI", "SET", "INCRBY", "EXEC"))), (F.row_number().over(_by_client()) % 4 + 1).cast("int"))
    return t.log().withColumn("cmd", cmd).select("seq", "client_id", "cmd", "key")


def _by_client():
    from pyspark.sql import Window

    return Window.partitionBy("client_id").orderBy("seq")


query("txn_exec", "SELECT client_id, seq AS exec_seq, CAST(2 AS BIGINT) AS commands FROM (SELECT seq, client_id, row_number() OVER (PARTITION BY client_id ORDER BY seq) AS r FROM log) WHERE r%4=3 AND r>3")(lambda t: transactions.batches(_txn_log(t)).select("client_id", "exec_seq", "commands"))
query("log_fold_counter", "SELECT key, CAST(sum(CASE WHEN cmd<>'DEL' THEN v END) AS BIGINT) AS value FROM (SELECT *, max(CASE WHEN cmd IN ('SET','DEL') THEN seq END) OVER (PARTITION BY key) AS reset FROM log) WHERE reset IS NULL OR seq>=reset GROUP BY key HAVING sum(CASE WHEN cmd<>'DEL' THEN v END) IS NOT NULL")(lambda t: fold.counters(t.log()))
_mlog = lambda t: t.log().select("seq", F.when(F.col("cmd") == "SET", "SREM").when(F.col("cmd") == "DEL", F.when(F.col("seq") % 7 == 0, "DEL").otherwise("SADD")).otherwise("SADD").alias("cmd"), "key", (F.col("v") % 17).cast("string").alias("member"), F.col("v").cast("string").alias("v"))
_ML = "SELECT seq, CASE WHEN cmd='SET' THEN 'SREM' WHEN cmd='DEL' AND seq%7=0 THEN 'DEL' ELSE 'SADD' END AS cmd, key, CAST(v%17 AS VARCHAR) AS member, v FROM log"
_LAST = f"SELECT key, member, arg_max(cmd, seq) AS cmd, arg_max(v, seq) AS v FROM ({_ML}) m WHERE cmd<>'DEL' AND seq>coalesce((SELECT max(seq) FROM ({_ML}) d WHERE d.cmd='DEL' AND d.key=m.key),-1) GROUP BY key, member"
query("log_fold_set", f"SELECT key, member FROM ({_LAST}) WHERE cmd='SADD'")(lambda t: fold.members(_mlog(t)))
query("log_fold_hash", f"SELECT key, member AS field, CAST(v AS VARCHAR) AS value FROM ({_LAST}) WHERE cmd='SADD'")(lambda t: fold.fields(_mlog(t).select("seq", F.when(F.col("cmd") == "SADD", "HSET").when(F.col("cmd") == "SREM", "HDEL").otherwise("DEL").alias("cmd"), "key", F.col("member").alias("field"), "v")))
query("log_fold_zset", "SELECT key, member, CAST(sum(CASE WHEN cmd<>'DEL' THEN v END) AS DOUBLE) AS score FROM (SELECT *, max(CASE WHEN cmd IN ('SET','DEL') THEN seq END) OVER (PARTITION BY key, member) AS reset FROM (SELECT *, CAST(seq%3 AS VARCHAR) AS member FROM log)) WHERE reset IS NULL OR seq>=reset GROUP BY key, member HAVING sum(CASE WHEN cmd<>'DEL' THEN v END) IS NOT NULL")(lambda t: fold.scores(t.log().select("seq", F.when(F.col("cmd") == "SET", "ZADD").when(F.col("cmd") == "DEL", "ZREM").otherwise("ZINCRBY").alias("cmd"), "key", (F.col("seq") % 3).cast("string").alias("member"), F.col("v").cast("double").alias("v"))))
query("log_fold_string", "SELECT concat('u:',user_id) AS key, string_agg(substr(event_type,1,1), '' ORDER BY event_id) AS value FROM events GROUP BY user_id")(lambda t: fold.strings(t.table("events").select(F.col("event_id").alias("seq"), F.lit("APPEND").alias("cmd"), F.concat(F.lit("u:"), F.col("user_id")).alias("key"), F.substring("event_type", 1, 1).alias("value"))))


def _state_log(t: Tables) -> DataFrame:
    """at, ord, db, cmd, argv: five commands for each event, a flush of database 1 halfway, and in the end a new name for each counter."""
    text = lambda c: F.col(c).cast("string")
    row = lambda n, db, cmd, *argv: F.struct(F.lit(n).alias("ord"), F.lit(db).alias("db"), cmd.alias("cmd"), F.array(*argv).alias("argv"))
    key = lambda kind: F.concat(F.lit(kind), "user_id")
    e = t.table("events").withColumn("v", F.round(F.col("value") * 100).cast("long"))
    counter = F.element_at(F.array(*map(F.lit, ("SET", "INCRBY", "INCRBY", "DEL", "INCRBY"))), (F.col("event_id") % 5 + 1).cast("int"))
    argv = F.when(counter == "DEL", F.array(key("u:"))).otherwise(F.array(key("u:"), text("v")))
    five = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit(0).alias("db"), counter.alias("cmd"), argv.alias("argv")),
        row(1, 0, F.when(F.col("event_id") % 7 == 0, "SREM").otherwise("SADD"), key("s:"), F.col("event_type")),
        row(2, 1, F.lit("HSET"), key("h:"), F.col("event_type"), text("v")),
        row(3, 0, F.lit("ZADD"), key("z:"), text("v"), F.col("event_type")),
        row(4, 0, F.lit("RPUSH"), key("l:"), F.col("event_type")),
    )
    last = F.lit(2**63 - 1)
    flush = e.agg(F.expr("max(event_id) div 2").alias("at")).select("at", F.lit(9).alias("ord"), F.lit(1).alias("db"), F.lit("FLUSHDB").alias("cmd"), F.array().cast("array<string>").alias("argv"))
    names = e.select("user_id").distinct().select(last.alias("at"), F.lit(0).alias("ord"), F.lit(0).alias("db"), F.lit("RENAME").alias("cmd"), F.array(key("u:"), key("v:")).alias("argv"))
    return e.select(F.col("event_id").alias("at"), F.inline(five)).unionByName(flush).unionByName(names)


def _relations(t: Tables) -> dict[str, DataFrame]:
    """The relations in databases of their own, since some names are used twice."""
    own = {"kv_string": (0, t.strings()), "kv_list": (0, t.lists()), "kv_hash": (1, t.hashes()), "kv_set": (2, t.sets()), "kv_zset": (3, t.zsets())}
    return {name: df.withColumn("db", F.lit(db)) for name, (db, df) in own.items()}


def _written_once(log: DataFrame) -> DataFrame:
    """A replay reads its log three times; one that is costly to make is written first."""
    need_checkpoints(log.sparkSession)
    return log.checkpoint()


_EVENTS = "SELECT *, CAST(round(value*100) AS BIGINT) AS v FROM events"
query(
    "log_replay",
    "SELECT 0 AS db, replace(key, 'u:', 'v:') AS key, 'string' AS type, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS field, CAST(n AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS score"
    " FROM (SELECT key, CAST(sum(CASE WHEN cmd<>'DEL' THEN v END) AS BIGINT) AS n"
    " FROM (SELECT *, max(CASE WHEN cmd IN ('SET','DEL') THEN seq END) OVER (PARTITION BY key) AS reset FROM log) WHERE reset IS NULL OR seq>=reset GROUP BY key) WHERE n IS NOT NULL"
    " UNION ALL SELECT 0, concat('s:',user_id), 'set', NULL, event_type, NULL, NULL FROM events GROUP BY user_id, event_type HAVING arg_max(event_id%7, event_id)<>0"
    f" UNION ALL SELECT 1, concat('h:',user_id), 'hash', NULL, event_type, CAST(arg_max(v, event_id) AS VARCHAR), NULL FROM ({_EVENTS}) WHERE event_id>(SELECT max(event_id)//2 FROM events) GROUP BY user_id, event_type"
    f" UNION ALL SELECT 0, concat('z:',user_id), 'zset', NULL, event_type, NULL, CAST(arg_max(v, event_id) AS DOUBLE) FROM ({_EVENTS}) GROUP BY user_id, event_type"
    " UNION ALL SELECT 0, concat('l:',user_id), 'list', row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1, NULL, event_type, NULL FROM events",
)(lambda t: replay.replay(_state_log(t), 0, ("at", "ord")).drop("fields", "expire_at_ms"))
query(
    "log_compact",
    "SELECT 0 AS db, key, 'string' AS type, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS field, value, CAST(NULL AS DOUBLE) AS score, expire_at_ms FROM live_string"
    " UNION ALL SELECT 0, key, 'list', i, NULL, element, NULL, NULL FROM kv_list"
    " UNION ALL SELECT 1, key, 'hash', NULL, field, value, NULL, NULL FROM kv_hash"
    " UNION ALL SELECT 2, key, 'set', NULL, member, NULL, NULL, NULL FROM kv_set"
    " UNION ALL SELECT 3, key, 'zset', NULL, member, NULL, CAST(score AS DOUBLE), NULL FROM kv_zset",
)(lambda t: replay.replay(_written_once(replay.compact(_relations(t))), NOW).drop("fields"))

# Over whole relations: every command of the log, every customer a subscriber, every log row a watch, every entry pending.
_commands_of = lambda t: t.log().select("seq", "cmd", "key", F.when(F.col("cmd") == "DEL", F.array().cast("array<string>")).otherwise(F.array(F.col("v").cast("string"))).alias("argv"))
_COUNTED = "SELECT key, CAST(sum(CASE WHEN cmd<>'DEL' THEN v END) AS BIGINT) AS n FROM (SELECT *, max(CASE WHEN cmd IN ('SET','DEL') THEN seq END) OVER (PARTITION BY key) AS reset FROM log) WHERE reset IS NULL OR seq>=reset GROUP BY key"
query("log_fold_general", f"SELECT key, CASE WHEN n IS NULL THEN 'none' ELSE 'string' END AS type, CAST(0 AS BIGINT) AS pos, CAST(n AS VARCHAR) AS value, CAST(0 AS BIGINT) AS errors FROM ({_COUNTED})")(lambda t: fold.general(_commands_of(t)))
_CHANNELS = ("ev.click", "ev.view", "ev.purchase", "ev.signup", "ev.error")
_subs = lambda t: t.table("customer").select(F.col("c_custkey").alias("client_id"), F.lit("channel").alias("kind"), F.element_at(F.array(*map(F.lit, _CHANNELS)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("name"))
_SUB = "SELECT c_custkey AS client_id, CASE c_custkey%5 WHEN 0 THEN 'ev.click' WHEN 1 THEN 'ev.view' WHEN 2 THEN 'ev.purchase' WHEN 3 THEN 'ev.signup' ELSE 'ev.error' END AS name FROM customer"
# Each user has a channel, and each customer listens to that of one user.
query("pubsub_publish_channel", "SELECT event_id AS seq, c_custkey AS client_id FROM events JOIN customer ON user_id=c_custkey")(
    lambda t: pubsub.deliver_channels(
        t.table("events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u."), "user_id").alias("channel")),
        t.table("customer").select(F.col("c_custkey").alias("client_id"), F.lit("channel").alias("kind"), F.concat(F.lit("u."), "c_custkey").alias("name")),
    ).select("seq", "client_id")
)
query("pubsub_numsub", f"SELECT channel, (SELECT count(DISTINCT client_id) FROM ({_SUB}) WHERE name=channel) AS n FROM (SELECT DISTINCT concat('ev.',event_type) AS channel FROM events)")(lambda t: pubsub.num_sub(_subs(t), _msgs(t)))
query("pubsub_channels", f"SELECT DISTINCT name AS channel FROM ({_SUB}) WHERE name LIKE 'ev.%e%'")(lambda t: pubsub.channels(_subs(t), "ev.*e*"))
query("pubsub_subscribe", f"SELECT DISTINCT client_id, name FROM ({_SUB})")(lambda t: pubsub.subscribe(_subs(t), _subs(t)).select("client_id", "name"))
query("pubsub_unsubscribe", f"SELECT client_id, name FROM ({_SUB}) WHERE name<>'ev.click'")(lambda t: pubsub.unsubscribe(_subs(t), _subs(t).filter("name = 'ev.click'")).select("client_id", "name"))
_watch = lambda t: t.log().select("client_id", F.concat(F.lit("u:"), F.col("client_id") % 10).alias("key"), F.col("seq").alias("watch_seq"), (F.col("seq") + 30).alias("exec_seq"))
query("txn_watch_conflict", "SELECT DISTINCT w.client_id, w.seq+30 AS exec_seq FROM log w JOIN log x ON x.key=concat('u:',w.client_id%10) AND x.seq>w.seq AND x.seq<w.seq+30")(lambda t: transactions.conflicts(_watch(t), t.log().select("seq", "client_id", "key")))
_pel = lambda t: t.stream().select("key", F.lit("g").alias("grp"), "id_ms", "id_seq", F.concat(F.lit("c"), F.col("user_id") % 3).alias("consumer"), (F.col("id_ms") + 5).alias("delivery_ms"), F.lit(1).alias("delivery_count"), "event_id")
query("stream_xack", "SELECT key, id_ms, id_seq FROM pel WHERE consumer<>'c1'")(lambda t: streams.ack(_pel(t), _pel(t).filter("consumer = 'c1'")).select("key", "id_ms", "id_seq"))
query("stream_xclaim", f"SELECT key, id_ms, id_seq, CASE WHEN {_CLAIM_AT}-delivery_ms>=60000 THEN 'c9' ELSE consumer END AS consumer FROM pel")(lambda t: streams.claim(_pel(t), _pel(t), "c9", 60000, _CLAIM_AT).select("key", "id_ms", "id_seq", "consumer"))
query("stream_xautoclaim", f"SELECT key, id_ms, id_seq, CASE WHEN r<=9 AND idle THEN 'c9' ELSE consumer END AS consumer FROM (SELECT *, {_CLAIM_AT}-delivery_ms>=60000 AS idle, row_number() OVER (PARTITION BY key, {_CLAIM_AT}-delivery_ms>=60000 ORDER BY id_ms,id_seq) AS r FROM pel)")(lambda t: streams.auto_claim(_pel(t), "g", "c9", 60000, _CLAIM_AT, count=9).select("key", "id_ms", "id_seq", "consumer"))
query("stream_xpending_summary", "SELECT key, grp, count(*) AS n, min(id_ms) AS lo_ms, max(id_ms) AS hi_ms, count(DISTINCT consumer) AS consumers FROM pel GROUP BY key, grp")(lambda t: streams.pending_summary(_pel(t)))
query("stream_xpending_consumers", "SELECT key, grp, consumer, count(*) AS n FROM pel GROUP BY key, grp, consumer")(lambda t: streams.pending_by_consumer(_pel(t)))
query("stream_xpending_detail", f"SELECT key, id_ms, id_seq, {_CLAIM_AT}-delivery_ms AS idle_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms,id_seq) AS r FROM pel WHERE consumer='c1' AND {_CLAIM_AT}-delivery_ms>=0) WHERE r<=10")(lambda t: streams.pending(_pel(t), _CLAIM_AT, 0, "c1", 10).select("key", "id_ms", "id_seq", "idle_ms"))

# What one request gives twice, keys of several databases, keys of any type that have expired.
_twice = lambda t: t.table("orders").select(F.concat(F.lit("nat:"), F.col("o_custkey") % 30).alias("key"), F.concat(F.lit("Customer#"), F.col("o_custkey") % 50).alias("member"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("ord"))
_TWICE = "SELECT concat('nat:',o_custkey%30) AS key, concat('Customer#',o_custkey%50) AS member, o_totalprice AS score, o_orderkey AS ord FROM orders"
query("zset_zadd_twice", f"SELECT coalesce(z.key,n.key) AS key, coalesce(z.member,n.member) AS member, coalesce(n.score,z.score) AS score FROM kv_zset z FULL JOIN (SELECT key, member, arg_max(score, ord) AS score FROM ({_TWICE}) GROUP BY key, member) n ON n.key=z.key AND n.member=z.member")(lambda t: zsets.add(t.zsets(), _twice(t)))
_FIELDS = "SELECT concat('cust:',o_custkey) AS key, substr(o_orderpriority,1,1) AS field, CAST(o_orderkey AS VARCHAR) AS value, o_orderkey AS ord FROM orders"
query("hash_hset_twice", f"SELECT key, field, value FROM kv_hash UNION ALL SELECT key, field, arg_max(value, ord) FROM ({_FIELDS}) GROUP BY key, field")(
    lambda t: hashes.set_(t.hashes(), t.table("orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.substring("o_orderpriority", 1, 1).alias("field"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("ord"))).select("key", "field", "value")
)
_two_dbs = lambda t: t.keyspace().unionByName(t.strings().select(F.lit(1).alias("db"), "key", F.lit("hash").alias("type"), F.lit(None).cast("long").alias("expire_at_ms")))
_TWO_DBS = "(SELECT * FROM live_keys UNION ALL SELECT 1, key, 'hash', NULL FROM kv_string)"
_both = lambda t: t.table("customer").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("db"), F.concat(F.lit("cust:"), "c_custkey").alias("key"))
query("key_type_two_dbs", f"SELECT d.db, concat('cust:',c_custkey) AS key, coalesce(k.type,'none') AS type FROM customer CROSS JOIN (SELECT 0 AS db UNION ALL SELECT 1) d LEFT JOIN {_TWO_DBS} k ON k.key=concat('cust:',c_custkey) AND k.db=d.db")(lambda t: generic.type_(_two_dbs(t), _both(t), NOW))
query("key_expire_db", f"SELECT db, key, CASE WHEN db=1 AND key LIKE 'cust:%' THEN {NOW + 5} ELSE expire_at_ms END AS expire_at_ms FROM {_TWO_DBS}")(lambda t: generic.expire(_two_dbs(t), _both(t).filter("db = 1"), NOW + 5, NOW).select("db", "key", "expire_at_ms"))
_odd = lambda df: df.withColumn("expire_at_ms", F.when(F.substring_index("key", ":", -1).try_cast("long") % 2 == 0, F.lit(NOW - 1)).otherwise(F.lit(NOW + 1)))
_ODD = "coalesce(TRY_CAST(split_part(key,':',2) AS BIGINT)%2,1)<>0"
query("set_smembers_expired", f"SELECT key, member FROM kv_set WHERE {_ODD}")(lambda t: visible(_odd(t.sets()), NOW).select("key", "member"))
query("list_lrange_expired", f"SELECT key, element FROM kv_list WHERE i<=2 AND {_ODD}")(lambda t: lists.range_(visible(_odd(t.lists()), NOW), 0, 2).select("key", "element"))
query("hash_hgetall_expired", f"SELECT key, field, value FROM kv_hash WHERE {_ODD} AND (fx IS NULL OR fx>={NOW})")(lambda t: visible(_odd(t.hashes()), NOW).select("key", "field", "value"))
query("zset_zrange_expired", f"SELECT key, member, score FROM zranked WHERE rank<=4 AND {_ODD}")(lambda t: zsets.top(visible(_odd(t.zsets()), NOW), 5).select("key", "member", "score"))

# Transactions that take effect: every client's commands come as WATCH, MULTI, two that are queued, EXEC.
_acts = lambda t: t.log().withColumn("r", F.row_number().over(_by_client()) % 5).select("seq", "client_id", F.element_at(F.array(*map(F.lit, ("WATCH", "MULTI", "SET", "INCRBY", "EXEC"))), (F.col("r") + 1).cast("int")).alias("cmd"), F.concat(F.lit("u:"), F.col("client_id") % 10).alias("key"))
_ACTS = "SELECT seq, client_id, row_number() OVER (PARTITION BY client_id ORDER BY seq)%5 AS r, concat('u:',client_id%10) AS key FROM log"
query(
    "txn_apply",
    f"SELECT * FROM (WITH a AS ({_ACTS}), e AS (SELECT *, min(CASE WHEN r=4 THEN seq END) OVER w AS act, max(CASE WHEN r=1 THEN seq END) OVER b AS opened, max(CASE WHEN r=4 THEN seq END) OVER b AS closed, max(CASE WHEN r=0 THEN seq END) OVER b AS watched "
    "FROM a WINDOW w AS (PARTITION BY client_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY client_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "q AS (SELECT seq, client_id, key, act, CASE WHEN watched>coalesce(closed,-1) THEN watched END AS watched FROM e WHERE r IN (2,3) AND act IS NOT NULL AND opened>coalesce(closed,-1)) "
    "SELECT seq, client_id, act AS \"at\" FROM q WHERE watched IS NULL OR NOT EXISTS (SELECT 1 FROM q x WHERE x.key=q.key AND x.act>q.watched AND x.act<q.act))",
)(lambda t: transactions.apply(_acts(t)).select("seq", "client_id", "at"))

# Cluster and scripts.
_CRC = "list_reduce(list_prepend(0, list_transform(range(1, strlen(key)+1), lambda i: CAST(ascii(substr(key,i,1)) AS INTEGER))), lambda c, b: list_reduce(list_prepend(xor(c, b<<8), [1,1,1,1,1,1,1,1]), lambda x, y: CASE WHEN (x & 32768)<>0 THEN xor((x<<1)&65535, 4129) ELSE (x<<1)&65535 END))"
query("cluster_keyslot", f"SELECT key, CAST({_CRC}%16384 AS INTEGER) AS slot FROM kv_string")(lambda t: cluster.key_slots(t.strings()))
query("cluster_countkeysinslot", f"SELECT CAST({_CRC}%16384 AS INTEGER) AS slot, count(*) AS n FROM kv_string GROUP BY 1")(lambda t: cluster.count_in_slots(t.strings()))
query("cluster_getkeysinslot", f"SELECT key FROM kv_string WHERE {_CRC}%16384=866")(lambda t: cluster.in_slot(t.strings(), 866))
query("cluster_slot_owner", f"SELECT key, CASE WHEN {_CRC}%16384<8192 THEN 'a' ELSE 'b' END AS node FROM kv_string")(lambda t: cluster.owners(t.strings(), t.spark.createDataFrame([("a", 0, 8191), ("b", 8192, 16383)], "node string, first int, last int")).select("key", "node"))
query("cluster_fail_quorum", "SELECT event_type AS node, count(DISTINCT user_id%10) AS reporters FROM events WHERE value>50 GROUP BY 1 HAVING count(DISTINCT user_id%10)>=6")(lambda t: cluster.failed(t.table("events").filter("value > 50").select(F.col("event_type").alias("node"), (F.col("user_id") % 10).alias("reporter")), 10))
query("sentinel_sdown_gap", "SELECT concat('u:',user_id) AS node, (SELECT max(epoch_us(ts)//1000) FROM events)-max(epoch_us(ts)//1000) AS gap_ms FROM events GROUP BY user_id HAVING (SELECT max(epoch_us(ts)//1000) FROM events)-max(epoch_us(ts)//1000)>30000")(lambda t: cluster.silent(t.log().select(F.col("key").alias("node"), F.col("ts_ms").alias("at_ms")), t.log().agg(F.max("ts_ms")).first()[0]))
query("script_sha1", "SELECT sha1(text) AS sha1 FROM documents")(lambda t: scripting.digests(t.table("documents").select(F.col("text").alias("src"))).select("sha1"))


@query("catalog_command_count", "SELECT * FROM (VALUES " + ", ".join(f"('{f}','{n}',{a},'{k}',{str(s).lower()})" for f, n, a, k, s in commands.rows()) + ") t(family, name, arity, kind, served)")
def _commands(t: Tables) -> DataFrame:
    return commands.catalogue(t.spark)


# Patterns that clients listen to: each customer has one.
_PATTERNS = ("ev.c*", "ev.*", "ev.[pv]*", "ev.?????", "x*")
_psubs = lambda t: t.table("customer").select(
    F.col("c_custkey").alias("client_id"),
    F.lit("pattern").alias("kind"),
    F.element_at(F.array(*map(F.lit, _PATTERNS)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("name"),
)
_PSUB = "SELECT c_custkey AS client_id, CASE c_custkey%5 WHEN 0 THEN 'ev.c*' WHEN 1 THEN 'ev.*' WHEN 2 THEN 'ev.[pv]*' WHEN 3 THEN 'ev.?????' ELSE 'x*' END AS name FROM customer"
query("pubsub_psubscribe", f"SELECT client_id, 'channel' AS kind, name FROM ({_SUB}) UNION ALL SELECT client_id, 'pattern', name FROM ({_PSUB})")(
    lambda t: pubsub.subscribe(_subs(t), _psubs(t).unionByName(_psubs(t)))
)
query("pubsub_punsubscribe", f"SELECT client_id, 'channel' AS kind, name FROM ({_SUB}) UNION ALL SELECT client_id, 'pattern', name FROM ({_PSUB}) WHERE name<>'ev.*' AND client_id%7<>0")(
    lambda t: pubsub.unsubscribe(
        _subs(t).unionByName(_psubs(t)),
        # One name, and for some clients all of their patterns.
        _psubs(t).filter("name = 'ev.*'").unionByName(_psubs(t).filter("client_id % 7 = 0").withColumn("name", F.lit(None).cast("string"))),
    )
)
query("pubsub_numpat", f"SELECT count(*) AS n FROM ({_PSUB})")(lambda t: pubsub.num_pat(_subs(t).unionByName(_psubs(t))))

# Scripts: a read, an addition, and a digest that nobody registered.
_SHA = {name: hashlib.sha1(name.encode()).hexdigest() for name in ("read", "add", "gone")}


def _scripts() -> scripting.Scripts:
    found = scripting.Scripts()
    values = lambda relations, calls: calls.join(relations["kv"].select("key", "value"), "key", "left")
    found.load(lambda relations, calls: values(relations, calls).select("seq", F.col("value").alias("reply")), "read")
    found.load(lambda relations, calls: values(relations, calls).select("seq", (F.col("value").try_cast("long") + F.col("arg")).cast("string").alias("reply")), "add")
    return found


query(
    "script_evalsha",
    "SELECT o_orderkey AS seq, CASE o_orderkey%3 WHEN 0 THEN k.value WHEN 1 THEN CAST(TRY_CAST(k.value AS BIGINT)+o_orderkey AS VARCHAR) END AS reply, CASE WHEN o_orderkey%3=2 THEN 'NOSCRIPT' END AS error"
    " FROM orders LEFT JOIN kv_counter k ON k.key=concat('bal:',o_custkey)",
)(
    lambda t: _scripts().call(
        t.table("orders").select(
            F.col("o_orderkey").alias("seq"),
            F.element_at(F.array(*map(F.lit, _SHA.values())), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("sha"),
            F.concat(F.lit("bal:"), "o_custkey").alias("key"),
            F.col("o_orderkey").alias("arg"),
        ),
        {"kv": t.counters()},
    )
)
query("script_exists", "SELECT * FROM (VALUES ('read', true), ('add', true), ('gone', false)) t(src, found)")(
    lambda t: t.spark.createDataFrame(list(zip(_SHA, _scripts().exists(*_SHA.values()))), "src string, found boolean")
)

# Server.
_asked = lambda t: t.table("orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("message"))
query("server_ping", "SELECT o_orderkey AS seq, CASE WHEN o_orderkey%2=0 THEN o_orderpriority ELSE 'PONG' END AS reply FROM orders")(lambda t: server.ping(_asked(t)))
query("server_echo", "SELECT o_orderkey AS seq, CASE WHEN o_orderkey%2=0 THEN o_orderpriority END AS reply, CASE WHEN o_orderkey%2<>0 THEN 'SYNTAX' END AS error FROM orders")(lambda t: server.echo(_asked(t)))
query("server_time", "SELECT event_id, epoch_us(ts)//1000000 AS seconds, (epoch_us(ts)//1000)%1000*1000 AS micros FROM events")(
    lambda t: t.table("events").select("event_id", *server.clock(F.unix_millis(F.col("ts").cast("timestamp"))))
)
query("server_time_now", None)(lambda t: server.time(t.spark))
query("server_info_keyspace", "SELECT db, count(*) AS keys, count(expire_at_ms) AS expires FROM live_keys GROUP BY db")(lambda t: server.keyspace_info(t.keyspace(), NOW))
_ASKED = ("Databases", "hash-max-*", "*", "none")
query(
    "server_config_get",
    "SELECT p.seq, s.name, s.value FROM (VALUES (0,'databases',false),(1,'hash-max-',true),(2,'',true),(3,'none',false)) p(seq, pattern, starts), (VALUES "
    + ", ".join(f"('{n}','{v}')" for n, v in commands.SETTINGS)
    + ") s(name, value) WHERE CASE WHEN starts THEN starts_with(name, pattern) ELSE name=pattern END",
)(lambda t: server.settings(commands.settings(t.spark), t.spark.createDataFrame(list(enumerate(_ASKED)), "seq int, pattern string")))
query("key_object_info", "SELECT db, key, 1 AS refcount, 0 AS idle, 0 AS freq FROM live_keys")(lambda t: generic.object_info(t.keyspace(), NOW))

# Errors that depend on data.
query("key_wrongtype", "SELECT c_custkey AS seq, CASE WHEN k.type IS NOT NULL AND k.type<>CASE WHEN c_custkey%2=0 THEN 'string' ELSE 'list' END THEN 'WRONGTYPE' END AS error FROM customer LEFT JOIN live_keys k ON k.db=0 AND k.key=concat('cust:',c_custkey)")(
    lambda t: generic.wrong_type(
        t.keyspace(),
        t.table("customer").select(F.lit(0).alias("db"), F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "string").otherwise("list").alias("type"), F.col("c_custkey").alias("seq")),
        NOW,
    ).select("seq", "error")
)
query("stream_group_busy", "SELECT DISTINCT key, 'g' AS grp, CASE WHEN key='ev:click' THEN 'BUSYGROUP' END AS error FROM kv_stream")(
    lambda t: streams.group_busy(_groups(t).filter("key = 'ev:click'"), _groups(t)).select("key", "grp", "error")
)

# Replication: every user is a replica, which reports the events it has seen; the master is where the log ends.
_reports = lambda t: t.table("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("replica"), F.col("event_id").alias("offset"))
query("replication_ack", 'SELECT user_id AS replica, max(event_id) AS "offset" FROM events GROUP BY user_id')(lambda t: replication.acknowledged(_reports(t)))
query("replication_wait", "SELECT count(*) AS acked FROM (SELECT max(event_id) AS m FROM events GROUP BY user_id) WHERE m>=(SELECT max(event_id)-100 FROM events)")(
    lambda t: replication.wait(replication.acknowledged(_reports(t)), t.log().agg(F.max("seq")).first()[0] - 100)
)


@query(
    "replication_psync",
    "SELECT replica, CASE WHEN ok THEN 'CONTINUE' ELSE 'FULLRESYNC' END AS reply, CASE WHEN ok THEN m ELSE last END AS start FROM"
    " (SELECT user_id AS replica, max(event_id) AS m, (SELECT max(event_id) FROM events) AS last, user_id%5<>0 AND max(event_id)>=(SELECT max(event_id)-200 FROM events) AS ok FROM events GROUP BY user_id)",
)
def _psync(t: Tables) -> DataFrame:
    last = t.log().agg(F.max("seq")).first()[0]
    asked = replication.acknowledged(_reports(t)).withColumn("replid", F.when(F.col("replica") % 5 != 0, "m"))
    return replication.resync(asked, "m", last - 200, last)


query("replication_tail", "SELECT seq, cmd, key FROM log WHERE seq>(SELECT max(seq)//2 FROM log)")(
    lambda t: replication.tail(t.log(), t.log().agg(F.floor(F.max("seq") / 2)).first()[0]).select("seq", "cmd", "key")
)

# Health of nodes: a quorum of watchers, votes of an epoch.
query("sentinel_odown", "SELECT event_type AS node, count(DISTINCT user_id%10) AS reporters FROM events WHERE value>50 GROUP BY 1 HAVING count(DISTINCT user_id%10)>=3")(
    lambda t: cluster.objectively_down(t.table("events").filter("value > 50").select(F.col("event_type").alias("node"), (F.col("user_id") % 10).alias("reporter")), 3)
)
query("sentinel_ckquorum", "SELECT event_type AS node, count(DISTINCT CASE WHEN value>50 THEN user_id END) AS reachable, count(DISTINCT CASE WHEN value>50 THEN user_id END)>=2 AND count(DISTINCT CASE WHEN value>50 THEN user_id END)*2>count(DISTINCT user_id) AS ok FROM events GROUP BY 1")(
    lambda t: cluster.can_fail_over(t.table("events").select(F.col("event_type").alias("node"), F.col("user_id").alias("watcher"), (F.col("value") > 50).alias("reachable")), 2)
)
query(
    "cluster_election",
    "SELECT epoch, candidate, count(*) AS votes FROM (SELECT event_id//50 AS epoch, user_id%7 AS voter, arg_min(event_type, event_id) AS candidate FROM events GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*)>=4",
)(lambda t: cluster.elected(t.table("events").select(F.floor(F.col("event_id") / 50).cast("long").alias("epoch"), (F.col("user_id") % 7).alias("voter"), F.col("event_type").alias("candidate"), F.col("event_id").alias("seq")), 7))
