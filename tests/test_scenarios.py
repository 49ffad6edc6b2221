"""Literal scenarios: small relations with known results."""

import math

import pytest
from pyspark.sql import functions as F

from keyloom.errors import NoScript
from keyloom.functions import geohash
from keyloom.functions.slots import crc16, key_slot
from keyloom.functions.text import glob_regex
from keyloom.operators import generic, geo, hashes, lists, pubsub, scripting, sets, sketches, streams, strings, zsets

NOW = 1000


def kv(spark, **values):
    return spark.createDataFrame([(k, v, None) for k, v in values.items()], "key string, value string, expire_at_ms long")


def cells(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def rows(spark, key, *elements):
    return spark.createDataFrame([(key, i, e) for i, e in enumerate(elements)], "key string, pos long, element string")


def in_order(df):
    return [r.element for r in lists.dense(df).orderBy("key", "i").collect()]


def test_mget_and_expiry(spark):
    s = spark.createDataFrame([("k1", "v1", None), ("k2", "v2", 1000), ("k3", "v3", 999)], "key string, value string, expire_at_ms long")
    asked = spark.createDataFrame(list(enumerate(["k1", "k2", "k3", "k4"])), "ord int, key string")
    assert cells(strings.get(s, asked, NOW), "ord", "value") == [(0, "v1"), (1, "v2"), (2, None), (3, None)]


def test_set_only_if(spark):
    s, new = kv(spark, key="first"), kv(spark, key="new", other="x")
    assert cells(strings.set_(s, new, NOW, "nx"), "key", "value") == [("key", "first"), ("other", "x")]
    assert cells(strings.set_(s, new, NOW, "xx"), "key", "value") == [("key", "new")]
    assert cells(strings.set_if_none(s, new, NOW), "key", "value") == [("key", "first")]
    with pytest.raises(ValueError):
        strings.set_(s, new, NOW, "no")


def test_increments(spark):
    s = kv(spark, counter="10", plus="+5", word="x", big=str(2**63 - 1), gap=" 5")
    d = spark.createDataFrame([("counter", 5), ("counter", -3), ("plus", 1), ("word", 1), ("big", 1), ("none", 1), ("gap", 1)], "key string, delta long")
    got = {r.key: (r.value, r.error) for r in strings.increment(s, d, NOW).collect()}
    assert got["counter"] == ("12", None) and got["plus"] == ("6", None) and got["none"] == ("1", None)
    assert got["word"][0] is None and "integer" in got["word"][1] and "overflow" in got["big"][1] and got["gap"][0] is None
    f = strings.increment_float(kv(spark, float="10.5"), spark.createDataFrame([("float", 1.5)], "key string, delta double"), NOW).first()
    assert (f.number, f.value) == (12.0, "12")


def test_ranges_of_bytes(spark):
    s = kv(spark, k="Amber Cloud")
    for (a, b), want in {(0, 4): "Amber", (6, 10): "Cloud", (-5, -1): "Cloud", (5, 2): "", (0, 100): "Amber Cloud"}.items():
        assert strings.get_range(s, a, b, NOW).first().part == want
    assert strings.set_range(s, 6, "There", NOW).first().value == "Amber There"
    assert strings.set_range(kv(spark, k="ab"), 4, "x", NOW).first().value == "ab\x00\x00x"
    assert strings.append(kv(spark, k="Amber"), spark.createDataFrame([("k", 2, "d"), ("k", 1, " Clou")], "key string, ord int, tail string"), NOW).first().value == "Amber Cloud"


def test_lists(spark):
    new = spark.createDataFrame([("l", i, e) for i, e in enumerate("cba")], "key string, ord int, element string")
    assert in_order(lists.push(rows(spark, "l"), new, True)) == ["a", "b", "c"]
    abc = rows(spark, "l", "a", "b", "c")
    assert [lists.index(abc, i).collect() and lists.index(abc, i).first().element for i in (0, -1, 10)] == ["a", "c", []]
    assert [r.element for r in lists.insert(rows(spark, "l", "a", "c"), "c", "b", True).orderBy("i").collect()] == ["a", "b", "c"]
    assert in_order(lists.remove(rows(spark, "l", "a", "b", "a", "a", "c"), 2, "a")) == ["b", "a", "c"]
    assert in_order(lists.remove(rows(spark, "l", "a", "b", "a", "a", "c"), -2, "a")) == ["a", "b", "c"]
    assert [r.element for r in lists.range_(rows(spark, "l", *"abcde"), -3, -1).orderBy("i").collect()] == ["c", "d", "e"]
    x = rows(spark, "l", "x", "y", "x", "z", "x")
    assert cells(lists.position(x, "x", count=0), "i") == [(0,), (2,), (4,)]
    assert cells(lists.position(rows(spark, "l", "a", "b", "c", "b"), "b", rank=2), "i") == [(3,)]
    assert cells(lists.position(x, "x", rank=-1), "i") == [(4,)]
    both = rows(spark, "s", "a", "b", "c").unionByName(rows(spark, "d", "x"))
    moved = lists.move(both, spark.createDataFrame([("s", "d")], "source string, target string"), True, False)
    assert in_order(moved.filter("key='d'")) == ["x", "a"] and in_order(moved.filter("key='s'")) == ["b", "c"]
    turned = lists.move(abc, spark.createDataFrame([("l", "l")], "source string, target string"), True, False)
    assert in_order(turned) == ["b", "c", "a"]


def test_hashes(spark):
    h = spark.createDataFrame([("h", "f1", "1", None), ("h", "f2", "v2", 5000), ("h", "f3", "v3", 500)], "key string, field string, value string, field_expire_at_ms long")
    asked = spark.createDataFrame([("h", f) for f in ("f1", "f2", "f3", "f4")], "key string, field string")
    assert [r.ttl for r in hashes.ttl(h, asked, NOW).orderBy("field").collect()] == [-1, 4, -2, -2]
    assert [r.code for r in hashes.expire(h, asked, 4000, NOW, "gt").orderBy("field").collect()] == [1, 0, 1, -2]
    assert [r.code for r in hashes.persist(h, asked).orderBy("field").collect()] == [-1, 1, 1, -2]
    assert hashes.expired(h, asked, 10, NOW).count() == 0
    assert hashes.increment(h, spark.createDataFrame([("h", "f1", 5)], "key string, field string, delta long")).first().number == 6
    odd = spark.createDataFrame([("h", "a", "x", None), ("h", "b", str(2**63 - 1), None)], "key string, field string, value string, field_expire_at_ms long")
    got = {r.field: (r.number, bool(r.error)) for r in hashes.increment(odd, spark.createDataFrame([("h", f, 1) for f in "abc"], "key string, field string, delta long")).collect()}
    assert got == {"a": (None, True), "b": (None, True), "c": (1, False)}
    twice = spark.createDataFrame([("h", "z", "1", 1), ("h", "z", "0", 2)], "key string, field string, value string, ord int")
    assert [hashes.set_(odd, twice, only_new=x).filter("field = 'z'").collect()[0].value for x in (False, True)] == ["0", "1"]
    assert hashes.as_map(h).first().fields == {"f1": "1", "f2": "v2", "f3": "v3"}
    assert hashes.random_fields(h, 2, 1).count() == 2 and hashes.random_fields(h, -7, 1).count() == 7
    assert cells(hashes.page(h, "f1", 1), "field") == [("f2",)]


def test_sets(spark):
    s = spark.createDataFrame([("a", x) for x in "abcd"] + [("b", x) for x in "bcde"], "key string, member string")
    assert cells(sets.inter(s, ["a", "b"]), "member") == [("b",), ("c",), ("d",)]
    assert sets.inter(s, ["a", "none"]).count() == 0 and sets.inter_card(s, ["a", "b"], 1).first().card == 1
    assert cells(sets.diff(s, ["a", "b"]), "member") == [("a",)] and sets.union(s, ["a", "b"]).count() == 5
    assert ("b", "a") in cells(sets.move(s, "a", "b", "a"), "key", "member") and sets.move(s, "a", "b", "b").filter("key='a'").count() == 3
    popped, rest = sets.pop(s, 3, 7)
    assert popped.count() == 6 and rest.count() == 2 and popped.join(rest, ["key", "member"]).count() == 0
    assert sets.random_members(s, 9, 7).count() == 8


def test_zsets(spark):
    z = spark.createDataFrame([("z", m, float(i + 1)) for i, m in enumerate("abcd")], "key string, member string, score double")
    new = lambda m, s: spark.createDataFrame([("z", m, s)], "key string, member string, score double")
    score = lambda df, m: {r.member: r.score for r in df.collect()}.get(m)
    assert [r.member for r in zsets.range_(z, 0, -1).orderBy("rank").collect()] == list("abcd")
    assert [r.member for r in zsets.range_(z, 0, 1, reverse=True).orderBy("rank").collect()] == ["d", "c"]
    assert cells(zsets.range_by_score(z, 2, 3), "member") == [("b",), ("c",)] and cells(zsets.range_by_score(z, 2, 3, True), "member") == [("c",)]
    assert score(zsets.add(z, new("a", 0.5), better="gt"), "a") == 1.0 and score(zsets.add(z, new("a", 0.5), better="lt"), "a") == 0.5
    assert score(zsets.add(z, new("q", 0.5), only="xx"), "q") is None and score(zsets.add(z, new("a", 9.0), only="nx"), "a") == 1.0
    assert score(zsets.increment(z, new("a", 9.0)), "a") == 10.0 and score(zsets.increment(z, new("q", 9.0)), "q") == 9.0
    assert zsets.pop(z, 9, largest=True)[0].count() == 4 and zsets.pop(z, 9)[1].count() == 0
    assert cells(zsets.remove_by_rank(z, 0, -2), "member") == [("d",)] and cells(zsets.remove_by_score(z, 2, 3), "member") == [("a",), ("d",)]
    ties = spark.createDataFrame([("t", m, 1.0) for m in "cab"], "key string, member string, score double")
    assert [r.member for r in zsets.ranked(ties, True).orderBy("rank").collect()] == ["c", "b", "a"]
    assert cells(zsets.range_by_lex(ties, "(a", "+"), "member") == [("b",), ("c",)] and zsets.range_by_lex(ties, "+", "-").count() == 0
    both = z.unionByName(spark.createDataFrame([("y", "b", 3.0), ("y", "x", 4.0)], z.schema))
    assert cells(zsets.combine(both, ["z", "y"], True), "member", "score") == [("b", 5.0)] and zsets.combine(both, ["z", "y"], False).count() == 5
    assert cells(zsets.difference(both, ["y", "z"]), "member") == [("x",)]


def test_keys(spark):
    ks = spark.createDataFrame([(0, "shop:1", "string", None), (0, "shop:2", "string", 999), (0, "item:1", "list", 61_500)], "db int, key string, type string, expire_at_ms long")
    assert cells(generic.keys(ks, "shop:*", NOW), "key") == [("shop:1",)]
    asked = spark.createDataFrame([("shop:1",), ("shop:2",), ("item:1",), ("none",)], "key string")
    assert {r.key: r.ttl for r in generic.ttl(ks, asked, NOW).collect()} == {"shop:1": -1, "shop:2": -2, "item:1": 60, "none": -2}
    s = kv(spark, src="value", dst="taken")
    assert cells(generic.rename(s, "src", "dst"), "key", "value") == [("dst", "value")]
    assert cells(generic.rename(s, "src", "dst", True), "key", "value") == [("dst", "taken"), ("src", "value")]
    assert cells(generic.rename(s, "none", "dst"), "key", "value") == [("dst", "taken"), ("src", "value")]
    assert cells(generic.copy(s, "src", "dst"), "value") == [("taken",), ("value",)] and cells(generic.copy(s, "src", "dst", True), "value") == [("value",), ("value",)]
    e = {r.key: r.encoding for r in generic.encoding(kv(spark, i="12345", e="hello", r="x" * 50), "string").collect()}
    assert e == {"i": "int", "e": "embstr", "r": "raw"}
    many = spark.createDataFrame([("z", f"m{i}", 0.0) for i in range(129)], "key string, member string, score double")
    assert generic.encoding(many, "zset").first().encoding == "skiplist"


@pytest.mark.parametrize(("pattern", "yes", "no"), [("a*c", ["ac", "abc", "a\nc"], ["acd"]), ("?.x", ["a.x"], ["abx", ".x"]), ("[a-c]1", ["b1"], ["d1"]), ("[^a]1", ["b1"], ["a1"]), ("a+(b)", ["a+(b)"], ["aab"]), ("[", ["["], ["a"])])
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "x string").filter(F.col("x").rlike(glob_regex(pattern)))
    assert {r.x for r in df.collect()} == set(yes)


def test_slots(spark):
    df = spark.createDataFrame([("123456789",), ("foo",), ("hello",), ("{foo}bar",), ("a{}b",), ("",)], "key string")
    got = {r.key: (r.c, r.s) for r in df.select("key", crc16(F.col("key")).alias("c"), key_slot(F.col("key")).alias("s")).collect()}
    assert got["123456789"][0] == 12739 and got["foo"][1] == got["{foo}bar"][1] == 12182 and got["hello"][1] == 866 and got[""] == (0, 0)


def test_geo(spark):
    p = spark.createDataFrame([("g", "palermo", 13.361389, 38.115556), ("g", "catania", 15.087269, 37.502669), ("g", "off", 0.0, 89.0)], "key string, member string, lon double, lat double")
    z = geo.add(p)
    assert {r.member: int(r.score) for r in z.collect()}["palermo"] == 3560857026147767 and z.count() == 2
    where = {r.member: (r.lon, r.lat) for r in geo.position(z).collect()}
    assert math.dist(where["palermo"], (13.361389, 38.115556)) < 1e-4
    d = geo.distance(z, spark.createDataFrame([("g", "palermo", "catania")], "key string, a string, b string"), "km").first().distance
    assert abs(d - 166.27) < 0.2
    assert cells(geo.search(z, 15.0, 37.0, 100, "km"), "member") == [("catania",)] and geo.search(z, 15.0, 37.0, 200, "km", count=1).count() == 1
    assert geo.search_box(z, 15.0, 37.0, 400, 400, "km", true_box=True).count() == 2
    assert len(geo.hash_text(z).first().hash) == 11 and geohash.BITS == 26


def test_sketch(spark):
    df = spark.range(100).select(F.lit("h").alias("key"), F.concat(F.lit("part-"), "id").alias("element"))
    s = sketches.add(df)
    assert 90 <= sketches.count(s).first().estimate <= 110 and 90 <= sketches.count_together(s.union(s)).first().estimate <= 110


def test_streams(spark):
    s = spark.createDataFrame([("s", 1000, 0), ("s", 2000, 0), ("s", 3000, 0)], "key string, id_ms long, id_seq long")
    assert streams.range_(s, (1000, 0), (2000, 0)).count() == 2
    assert cells(streams.read(s, spark.createDataFrame([("s", 1000, 0)], "key string, last_ms long, last_seq long")), "id_ms") == [(2000,), (3000,)]
    assert cells(streams.trim(s, 1), "id_ms") == [(3000,)]
    groups = spark.createDataFrame([("s", "g", 0, 0)], "key string, grp string, last_ms long, last_seq long")
    got, pel, moved = streams.group_read(s, groups, "c1", 9000, 2)
    assert got.count() == 2 and cells(moved, "last_ms") == [(2000,)] and pel.count() == 2
    assert streams.ack(pel, pel.filter("id_ms = 1000")).count() == 1
    claimed = streams.claim(pel, pel, "c2", 0, 9500)
    assert {r.consumer for r in claimed.collect()} == {"c2"} and {r.consumer for r in streams.claim(pel, pel, "c2", 600, 9500).collect()} == {"c1"}
    assert streams.pending_summary(pel).first().n == 2 and streams.info(s).first().last_ms == 3000
    assert streams.group_read(s, groups, "c", 1, no_ack=True)[1].count() == 0


def test_pubsub_and_scripts(spark):
    msgs = spark.createDataFrame([(1, "news.a"), (2, "other")], "seq long, channel string")
    subs = spark.createDataFrame([(7, "channel", "other"), (8, "pattern", "n*")], "client_id long, kind string, name string")
    assert cells(pubsub.deliver_channels(msgs, subs), "seq", "client_id") == [(2, 7)]
    assert cells(pubsub.deliver_patterns(msgs, pubsub.with_regex(spark, [(8, "n*")])), "seq", "client_id") == [(1, 8)]
    assert pubsub.num_pat(subs).first().n == 1
    scripts = scripting.Scripts()
    sha = scripts.load(lambda rel, keys, args: rel["kv"].filter(F.col("key") == keys[0]), "source")
    assert scripts.exists(sha, "no") == [True, False] and scripts.run(sha, {"kv": kv(spark, a="1", b="2")}, ["b"], []).first().value == "2"
    scripts.flush()
    with pytest.raises(NoScript):
        scripts.run(sha, {}, [], [])


def test_member_given_twice(spark):
    z = spark.createDataFrame([("z", "a", 3.0)], "key string, member string, score double")
    new = spark.createDataFrame([("z", "a", 5.0, 1), ("z", "a", 2.0, 2), ("z", "b", 7.0, 3), ("z", "b", 1.0, 4)], "key string, member string, score double, ord int")
    for kind, want in (({}, [2.0, 1.0]), ({"only": "nx"}, [3.0, 7.0]), ({"only": "xx"}, [2.0]), ({"better": "gt"}, [5.0, 7.0]), ({"better": "lt"}, [2.0, 1.0]), ({"incr": True}, [10.0, 8.0])):
        assert [r.score for r in zsets.add(z, new, **kind).orderBy("member").collect()] == want


def test_cells_near_a_point_hold_the_circle():
    import math
    import random

    from keyloom.functions import geohash as G

    random.seed(3)
    cell = lambda lon, lat: sum((int((lon + 180) / 360 * 2**26) >> i & 1) << 2 * i | (int((lat + 90) / 180 * 2**26) >> i & 1) << 2 * i + 1 for i in range(26))
    for _ in range(300):
        lon, lat, metres = random.uniform(-180, 180), random.uniform(-85, 85), 10 ** random.uniform(0, 7.3)
        ranges = G.near_cells(lon, lat, metres)
        assert 0 < len(ranges) < 80
        for _ in range(40):
            d, b = random.uniform(0, min(metres / G.RADIUS, math.pi)), random.uniform(0, 2 * math.pi)
            y = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(b))
            x = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(y))
            at = cell((math.degrees(x) + 180) % 360 - 180, math.degrees(y))
            assert any(lo <= at <= hi for lo, hi in ranges)


def test_transactions_take_effect(spark):
    from keyloom.operators import transactions

    log = [
        (1, 1, "WATCH", "a"), (2, 1, "MULTI", None), (3, 1, "SET", "x"), (4, 2, "SET", "a"), (5, 1, "EXEC", None),  # another wrote a
        (6, 1, "WATCH", "a"), (7, 1, "SET", "a"), (8, 1, "MULTI", None), (9, 1, "SET", "y"), (10, 1, "EXEC", None),  # so did the watcher
        (11, 1, "WATCH", "a"), (12, 1, "SET", "a"), (13, 1, "UNWATCH", None), (14, 1, "MULTI", None), (15, 1, "SET", "z"), (16, 1, "EXEC", None),
        (17, 3, "MULTI", None), (18, 3, "SET", "q"), (19, 3, "DISCARD", None), (20, 3, "MULTI", None), (21, 3, "SET", "r"), (22, 3, "SET", "a"), (24, 3, "EXEC", None),
        (23, 4, "WATCH", "a"), (25, 4, "MULTI", None), (26, 4, "SET", "s"), (27, 4, "EXEC", None),  # r and a were written at 24
        (28, 5, "MULTI", None), (29, 5, "SET", "never"), (30, 6, "WATCH", "b"), (31, 6, "MULTI", None), (32, 6, "SET", "b"), (33, 6, "EXEC", None),
    ]
    got = transactions.apply(spark.createDataFrame(log, "seq long, client_id long, cmd string, key string")).collect()
    assert sorted((r.seq, r.at) for r in got) == [(4, 4), (7, 7), (12, 12), (15, 16), (21, 24), (22, 24), (32, 33)]
