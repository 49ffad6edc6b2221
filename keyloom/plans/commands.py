"""The operator catalogue: each command, its arity and kind, and the settings that CONFIG GET knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Family, name, arity (negative: at least so many words), kind.
COMMANDS = [
    ("string", "get", 2, "read"),
    ("string", "set", -3, "write"),
    ("string", "mget", -2, "read"),
    ("string", "mset", -3, "write"),
    ("string", "msetnx", -3, "write"),
    ("string", "incr", 2, "write"),
    ("string", "decr", 2, "write"),
    ("string", "incrby", 3, "write"),
    ("string", "decrby", 3, "write"),
    ("string", "incrbyfloat", 3, "write"),
    ("string", "append", 3, "write"),
    ("string", "strlen", 2, "read"),
    ("string", "getrange", 4, "read"),
    ("string", "setrange", 4, "write"),
    ("string", "setnx", 3, "write"),
    ("string", "setex", 4, "write"),
    ("string", "psetex", 4, "write"),
    ("string", "getset", 3, "write"),
    ("string", "getdel", 2, "write"),
    ("string", "getex", -2, "write"),
    ("list", "lpush", -3, "write"),
    ("list", "rpush", -3, "write"),
    ("list", "lpop", -2, "write"),
    ("list", "rpop", -2, "write"),
    ("list", "llen", 2, "read"),
    ("list", "lrange", 4, "read"),
    ("list", "lindex", 3, "read"),
    ("list", "lset", 4, "write"),
    ("list", "linsert", 5, "write"),
    ("list", "lrem", 4, "write"),
    ("list", "lmove", 5, "write"),
    ("list", "lmpop", -4, "write"),
    ("list", "blpop", -3, "write"),
    ("list", "brpop", -3, "write"),
    ("list", "lpos", -3, "read"),
    ("list", "blmpop", -5, "write"),
    ("hash", "hset", -4, "write"),
    ("hash", "hmset", -4, "write"),
    ("hash", "hget", 3, "read"),
    ("hash", "hmget", -3, "read"),
    ("hash", "hdel", -3, "write"),
    ("hash", "hexists", 3, "read"),
    ("hash", "hlen", 2, "read"),
    ("hash", "hkeys", 2, "read"),
    ("hash", "hvals", 2, "read"),
    ("hash", "hgetall", 2, "read"),
    ("hash", "hincrby", 4, "write"),
    ("hash", "hincrbyfloat", 4, "write"),
    ("hash", "hsetnx", 4, "write"),
    ("hash", "hscan", -3, "read"),
    ("hash", "hrandfield", -2, "read"),
    ("hash", "hexpire", -6, "write"),
    ("hash", "hpexpire", -6, "write"),
    ("hash", "hexpireat", -6, "write"),
    ("hash", "hpexpireat", -6, "write"),
    ("hash", "httl", -5, "read"),
    ("hash", "hpttl", -5, "read"),
    ("hash", "hexpiretime", -5, "read"),
    ("hash", "hpexpiretime", -5, "read"),
    ("hash", "hpersist", -5, "write"),
    ("set", "sadd", -3, "write"),
    ("set", "srem", -3, "write"),
    ("set", "smembers", 2, "read"),
    ("set", "sismember", 3, "read"),
    ("set", "smismember", -3, "read"),
    ("set", "scard", 2, "read"),
    ("set", "sinter", -2, "read"),
    ("set", "sunion", -2, "read"),
    ("set", "sdiff", -2, "read"),
    ("set", "sintercard", -3, "read"),
    ("set", "sinterstore", -3, "write"),
    ("set", "sunionstore", -3, "write"),
    ("set", "sdiffstore", -3, "write"),
    ("set", "srandmember", -2, "read"),
    ("set", "spop", -2, "write"),
    ("set", "smove", 4, "write"),
    ("set", "sscan", -3, "read"),
    ("zset", "zadd", -4, "write"),
    ("zset", "zcard", 2, "read"),
    ("zset", "zscore", 3, "read"),
    ("zset", "zmscore", -3, "read"),
    ("zset", "zincrby", 4, "write"),
    ("zset", "zrank", -3, "read"),
    ("zset", "zrevrank", -3, "read"),
    ("zset", "zrange", -4, "read"),
    ("zset", "zrevrange", -4, "read"),
    ("zset", "zrangebyscore", -4, "read"),
    ("zset", "zrevrangebyscore", -4, "read"),
    ("zset", "zrangebylex", -4, "read"),
    ("zset", "zrevrangebylex", -4, "read"),
    ("zset", "zrem", -3, "write"),
    ("zset", "zremrangebyscore", 4, "write"),
    ("zset", "zremrangebyrank", 4, "write"),
    ("zset", "zremrangebylex", 4, "write"),
    ("zset", "zcount", 4, "read"),
    ("zset", "zpopmin", -2, "write"),
    ("zset", "zpopmax", -2, "write"),
    ("zset", "zrandmember", -2, "read"),
    ("zset", "zunionstore", -4, "write"),
    ("zset", "zinterstore", -4, "write"),
    ("zset", "zscan", -3, "read"),
    ("zset", "zrangestore", -5, "write"),
    ("zset", "zmpop", -4, "write"),
    ("zset", "bzmpop", -5, "write"),
    ("key", "del", -2, "write"),
    ("key", "unlink", -2, "write"),
    ("key", "exists", -2, "read"),
    ("key", "type", 2, "read"),
    ("key", "keys", 2, "read"),
    ("key", "scan", -2, "read"),
    ("key", "rename", 3, "write"),
    ("key", "renamenx", 3, "write"),
    ("key", "expire", -3, "write"),
    ("key", "pexpire", -3, "write"),
    ("key", "expireat", -3, "write"),
    ("key", "pexpireat", -3, "write"),
    ("key", "ttl", 2, "read"),
    ("key", "pttl", 2, "read"),
    ("key", "persist", 2, "write"),
    ("key", "select", 2, "other"),
    ("key", "dbsize", 1, "read"),
    ("key", "flushdb", -1, "write"),
    ("key", "flushall", -1, "write"),
    ("key", "randomkey", 1, "read"),
    ("key", "move", 3, "write"),
    ("key", "copy", -3, "write"),
    ("key", "touch", -2, "read"),
    ("key", "object", -2, "other"),
    ("key", "wait", 3, "other"),
    ("key", "dump", 2, "read"),
    ("key", "restore", -4, "write"),
    ("key", "expiretime", 2, "read"),
    ("key", "pexpiretime", 2, "read"),
    ("geo", "geoadd", -5, "write"),
    ("geo", "geodist", -4, "read"),
    ("geo", "geopos", -2, "read"),
    ("geo", "geohash", -2, "read"),
    ("geo", "geosearch", -7, "read"),
    ("geo", "geosearchstore", -8, "write"),
    ("hll", "pfadd", -2, "write"),
    ("hll", "pfcount", -2, "read"),
    ("hll", "pfmerge", -2, "write"),
    ("stream", "xadd", -5, "write"),
    ("stream", "xlen", 2, "read"),
    ("stream", "xrange", -4, "read"),
    ("stream", "xrevrange", -4, "read"),
    ("stream", "xread", -4, "read"),
    ("stream", "xdel", -3, "write"),
    ("stream", "xtrim", -4, "write"),
    ("stream", "xgroup", -2, "write"),
    ("stream", "xreadgroup", -7, "write"),
    ("stream", "xack", -4, "write"),
    ("stream", "xclaim", -6, "write"),
    ("stream", "xautoclaim", -7, "write"),
    ("stream", "xpending", -3, "read"),
    ("stream", "xinfo", -2, "read"),
    ("pubsub", "subscribe", -2, "other"),
    ("pubsub", "unsubscribe", -1, "other"),
    ("pubsub", "psubscribe", -2, "other"),
    ("pubsub", "punsubscribe", -1, "other"),
    ("pubsub", "publish", 3, "other"),
    ("pubsub", "pubsub", -2, "other"),
    ("txn", "multi", 1, "other"),
    ("txn", "exec", 1, "other"),
    ("txn", "discard", 1, "other"),
    ("txn", "watch", -2, "other"),
    ("txn", "unwatch", 1, "other"),
    ("script", "eval", -3, "other"),
    ("script", "evalsha", -3, "other"),
    ("script", "script", -2, "other"),
    ("server", "ping", -1, "other"),
    ("server", "echo", 2, "other"),
    ("server", "client", -2, "other"),
    ("server", "quit", 1, "other"),
    ("server", "reset", 1, "other"),
    ("server", "auth", -2, "other"),
    ("server", "info", -1, "other"),
    ("server", "config", -2, "other"),
    ("server", "command", -1, "other"),
    ("server", "slowlog", -2, "other"),
    ("server", "time", 1, "other"),
    ("server", "debug", -2, "other"),
    ("server", "latency", -2, "other"),
    ("server", "memory", -2, "read"),
    ("replication", "replicaof", 3, "other"),
    ("replication", "slaveof", 3, "other"),
    ("replication", "replconf", -3, "other"),
    ("replication", "psync", 3, "other"),
    ("replication", "wait", 3, "other"),
    ("cluster", "cluster", -2, "other"),
]
#: Commands that act on a network connection or a process, or that have no answer to give; a query engine has no counterpart.
CONNECTION_ONLY = "client quit reset auth slowlog debug latency dump restore".split()

# Name and value of each setting, as a server without a configuration file gives them.
SETTINGS = [
    ("maxmemory", "0"),
    ("maxmemory-policy", "noeviction"),
    ("databases", "16"),
    ("hz", "10"),
    ("bind", "127.0.0.1"),
    ("port", "6379"),
    ("tcp-backlog", "511"),
    ("timeout", "0"),
    ("tcp-keepalive", "300"),
    ("loglevel", "notice"),
    ("logfile", ""),
    ("save", "3600 1 300 100 60 10000"),
    ("appendonly", "no"),
    ("appendfsync", "everysec"),
    ("no-appendfsync-on-rewrite", "no"),
    ("auto-aof-rewrite-percentage", "100"),
    ("auto-aof-rewrite-min-size", "67108864"),
    ("aof-use-rdb-preamble", "yes"),
    ("list-max-listpack-size", "-2"),
    ("list-max-ziplist-size", "-2"),
    ("list-compress-depth", "0"),
    ("hash-max-listpack-entries", "128"),
    ("hash-max-listpack-value", "64"),
    ("hash-max-ziplist-entries", "128"),
    ("hash-max-ziplist-value", "64"),
    ("set-max-intset-entries", "512"),
    ("set-max-listpack-entries", "128"),
    ("set-max-listpack-value", "64"),
    ("zset-max-listpack-entries", "128"),
    ("zset-max-listpack-value", "64"),
    ("zset-max-ziplist-entries", "128"),
    ("zset-max-ziplist-value", "64"),
    ("activerehashing", "yes"),
    ("lazyfree-lazy-eviction", "no"),
    ("lazyfree-lazy-expire", "no"),
    ("lazyfree-lazy-server-del", "no"),
    ("repl-diskless-sync", "yes"),
    ("repl-diskless-sync-delay", "5"),
    ("repl-backlog-size", "1048576"),
    ("repl-timeout", "60"),
    ("requirepass", ""),
    ("maxclients", "10000"),
    ("activeexpire-enabled", "1"),
    ("active-expire-effort", "1"),
    ("cluster-enabled", "no"),
    ("cluster-node-timeout", "15000"),
    ("lua-time-limit", "5000"),
    ("slowlog-log-slower-than", "10000"),
    ("slowlog-max-len", "128"),
    ("latency-monitor-threshold", "0"),
    ("proto-max-bulk-len", "536870912"),
    ("client-query-buffer-limit", "1073741824"),
]


def rows() -> list[tuple[str, str, int, str, bool]]:
    """family, name, arity, kind, served."""
    return [(*c, c[1] not in CONNECTION_ONLY) for c in COMMANDS]


def catalogue(spark: SparkSession) -> DataFrame:
    """family, name, arity, kind, served (COMMAND)."""
    return spark.createDataFrame(rows(), "family string, name string, arity int, kind string, served boolean")


def settings(spark: SparkSession) -> DataFrame:
    """name, value of the settings."""
    return spark.createDataFrame(SETTINGS, "name string, value string")
