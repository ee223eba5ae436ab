"""Operators over a log: fixed examples, edge cases, and agreement of all ways to lay out the tiers."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from verslog.functions import keys as K
from verslog.operators import bloom, cache, families, index, merge, order, resolve, scan, ttl, txn
from verslog.operators.scan import Scan
from verslog.streaming import ship

LOG = "key string, value string, seq long, tombstone boolean, clash string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def log(spark, versions):
    return spark.createDataFrame([(k, v, s, t, "x") for k, v, s, t in versions], LOG)


def random_log(n=600, seed=3):
    rnd = random.Random(seed)
    out = []
    for s in range(1, n + 1):
        dead = rnd.choice([True, False, False, None])
        out.append((rnd.choice(["hot", "hot", f"k{rnd.randrange(40)}", "", None]), None if dead or rnd.random() < 0.1 else rnd.choice(["", "a", "b"]), s, dead))
    return out


def model(versions, at=10**9):
    out = {}
    for k, v, s, t in versions:
        if s <= at:
            out[k] = (v, s, bool(t))
    return out


# --- reads -----------------------------------------------------------------------------------------------------------


def test_newest_keeps_nulls_and_settles_ties(spark):
    df = log(spark, [("a", "1", 1, False), ("a", None, 2, False), ("b", "x", 3, None), ("b", "y", 3, None), ("c", "x", 4, False), ("c", None, 4, True), ("a", None, 2, False)])
    assert rows(resolve.newest(df).select("key", "value", "seq", "tombstone")) == [("a", None, 2, False), ("b", "y", 3, False), ("c", None, 4, True)]
    assert resolve.live(log(spark, [])).count() == 0


@pytest.mark.parametrize("at", [None, 250])
def test_live_follows_the_model(spark, at):
    versions = random_log()
    want = [(k, v, s) for k, (v, s, dead) in model(versions, at or 10**9).items() if not dead]
    assert rows(resolve.live(log(spark, versions), at=at).select("key", "value", "seq")) == sorted(want, key=repr)


def test_statuses(spark):
    df = log(spark, [("a", "1", 1, False), ("b", "2", 2, False), ("b", None, 3, True), ("d", "4", 4, False)])
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "key string")
    dead = spark.createDataFrame([("d", 100), ("a", 101)], "key string, expire_at_ns long")
    got = rows(resolve.get_status(df, wanted, deadlines=dead, now_ns=100))
    assert got == [("a", "FOUND", "1", 1), ("b", "DELETED", None, 3), ("c", "NOT_FOUND", None, None), ("d", "EXPIRED", None, None), ("d", "EXPIRED", None, None)]
    assert rows(resolve.seq_at(df, wanted.distinct(), 2)) == [("a", 1), ("b", 2), ("c", 0), ("d", 0)]


@pytest.mark.parametrize("cell", [16, 1 << 16])
def test_asof_follows_the_model(spark, cell):
    versions, rnd = random_log(), random.Random(1)
    probes = [(rnd.choice(["hot", "k1", "k2", "none", None, ""]), rnd.choice([None, rnd.randrange(700)]), i) for i in range(400)]
    want = []
    for k, at, i in probes:
        v = model(versions, at).get(k) if k is not None and at is not None else None
        want.append((k, at, i, *((v[1], v[2], v[0]) if v else (None, None, None))))
    got = resolve.asof(log(spark, versions), spark.createDataFrame(probes, "key string, at long, value int"), cell=cell)
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("cell", [7, 1 << 16])
def test_history(spark, cell):
    versions, want = random_log(), []
    for k in {v[0] for v in versions}:
        seqs = [s for key, _, s, _ in versions if key == k]
        want += [(k, s, p, n) for p, s, n in zip([None, *seqs], seqs, [*seqs[1:], None])]
    assert rows(resolve.history(log(spark, versions), cell)) == sorted(want, key=repr)


# --- scans -----------------------------------------------------------------------------------------------------------


def test_scan_options(spark):
    df = log(spark, [(k, k, i, False) for i, k in enumerate(["a", "b", "c", "d", "e", "p:a", "p:b", "p:c", "q:x"])] + [("c", None, 100, True)])
    got = lambda **o: [r.key for r in scan.scan(df, Scan(**o)).collect()]
    assert got(lower="b", upper="d") == ["b"]
    assert got(lower="b", upper="d", snapshot=50) == ["b", "c"]
    assert got(lower="b", upper="d", tombstones=True) == ["b", "c"]
    assert got(prefix="p:", lower="zzz", reverse=True) == ["p:c", "p:b", "p:a"]
    assert got(reverse=True, limit=2) == ["q:x", "p:c"]
    assert got(lower="e", upper="b") == []
    with pytest.raises(ValueError):
        scan.prefix_scan(df, "")


def test_cursor_and_neighbours(spark):
    df = log(spark, [(k, k, i, False) for i, k in enumerate("dbca")])
    c = scan.Cursor(scan.scan(df, Scan()))
    seen = [c.row.key]
    while c.next():
        seen.append(c.row.key)
    assert seen == list("abcd") and not c.valid and not c.next()
    assert c.prev() and c.row.key == "d" and c.prev() and c.row.key == "c" and c.next() and c.row.key == "d"
    short = scan.Cursor(scan.scan(df, Scan()), back=1)
    assert short.next() and short.next() and short.row.key == "c" and short.prev() and short.row.key == "b" and not short.prev() and short.next() and short.next() and short.next() and short.row.key == "d"
    empty = scan.Cursor(scan.scan(df.where("false"), Scan()))
    assert not empty.valid and not empty.prev()
    with pytest.raises(IndexError):
        empty.row
    assert rows(scan.neighbours(df)) == [("a", None, "b"), ("b", "a", "c"), ("c", "b", "d"), ("d", "c", None)]


@pytest.mark.parametrize("prefix, bound", [(b"a", b"b"), (b"a\xff", b"b"), (b"\xff\xff", None), (b"", None), (b"a\x00", b"a\x01"), ("a", "b"), ("퟿", ""), ("a\U0010ffff", "b"), ("\U0010ffff", None)])
def test_prefix_bound(prefix, bound):
    assert K.prefix_bound(prefix) == bound


def test_prefix_bound_column_and_codecs(spark):
    raw = [b"a", b"a\xff", b"\xff", b"", None, b"\x7f", b"\x0f\xff\xff"]
    df = spark.createDataFrame([(x,) for x in raw], "k binary").select("k", K.prefix_bound_column(F.col("k")).alias("b"))
    assert [r.b and bytes(r.b) for r in df.collect()] == [x and K.prefix_bound(x) for x in raw[:3]] + [None, None, b"\x80", b"\x10"]
    one = spark.createDataFrame([("fam", b"\x00k"), ("größe", b"")], "f string, k binary").withColumn("raw", K.family_key(F.col("f"), F.col("k")))
    family, key = K.split_family_key(F.col("raw"))
    assert [(r.f, bytes(r.k)) for r in one.select(family.alias("f"), key.alias("k")).collect()] == [("fam", b"\x00k"), ("größe", b"")]
    other = spark.createDataFrame([(b"plain",), (b"\x00cf\x00",)], "raw binary").select(*[c.alias(n) for c, n in zip(K.split_family_key(F.col("raw")), "fk")])
    assert [(r.f, bytes(r.k)) for r in other.collect()] == [(None, b"plain"), (None, b"\x00cf\x00")]
    ns = spark.createDataFrame([(1_700_000_000_123_456_789,), (0,)], "n long").select(K.deadline_bytes(F.col("n")).alias("b"))
    assert [r[0] for r in ns.select(K.deadline_ns(F.col("b"))).collect()] == [1_700_000_000_123_456_789, 0]
    system = spark.createDataFrame([(b"\x00ttl\x00a",), (b"\x00cf_meta",), (b"\x00cf\x00a\x00b",), (b"\x00idx\x00n\x00",), (b"ttl",)], "k binary")
    assert [r[0] for r in system.select(K.is_system_key(F.col("k"))).collect()] == [True, True, False, True, False]
    entry = spark.range(1).select(K.index_key(F.lit("n"), F.lit(b"e"), F.lit(b"p")).alias("k")).first().k
    assert bytes(entry) == b"\x00idx\x00n\x00e\x00p"


# --- tiers -----------------------------------------------------------------------------------------------------------


def test_merge_example(spark):
    a, b = log(spark, [("a", "old", 1, False), ("b", "b1", 1, False)]), log(spark, [("a", "new", 5, False), ("c", "c1", 5, False)])
    got = merge.merge_newest([a.withColumn("level", F.lit(1)), b.withColumn("level", F.lit(1))])
    assert rows(got.select("key", "value")) == [("a", "new"), ("b", "b1"), ("c", "c1")]
    snaps = lambda x: spark.createDataFrame(x, "id long, seq long, released boolean")
    assert merge.oldest_pinned(snaps([(1, 10, False), (2, 5, False), (3, 20, False)])).first()[0] == 5
    assert merge.oldest_pinned(snaps([(1, 10, False), (2, 5, True), (3, 20, False)])).first()[0] == 10
    assert merge.oldest_pinned(snaps([(1, 10, True)])).first()[0] == 2**63 - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_every_layout_reads_the_same(spark, seed):
    versions = random_log(seed=seed)
    whole = log(spark, versions)
    pins = [120, 333]
    tiers = [whole.where(c).withColumn("level", F.lit(n)) for n, c in enumerate(["seq > 500", "seq > 400 and seq <= 500", "seq > 200 and seq <= 400", "seq <= 200"])]
    bottom = merge.compact(tiers, pins, bottom=True)
    middle = merge.union_tiers([t.select("key", "value", "seq", "tombstone") for t in (tiers[0], merge.compact(tiers[1:3], pins, bottom=False), tiers[3])])
    want = lambda at: sorted([(k, v, s) for k, (v, s, dead) in model(versions, at).items() if not dead], key=repr)
    for layout in (whole, bottom, middle):
        for at in (*pins, 10**9):
            assert rows(resolve.live(layout, at=at).select("key", "value", "seq")) == want(at)
            ends = [r.key for r in scan.scan(layout.where("key is not null"), Scan(snapshot=at, reverse=True)).collect()]
            assert ends == sorted(ends, reverse=True) and len(ends) == len([1 for k, *_ in want(at) if k is not None])
    assert bottom.where(F.col("tombstone") & (F.col("seq") < min(pins))).count() == 0
    assert bottom.count() < whole.count()


def test_running_sums_and_pages(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i, i % 7) for i in range(500)], "key string, seq long, n int")
    got = {r.key: r.s for r in order.running_sum(df, [F.col("key")], F.col("n").cast("long"), "s", partitions=5).collect()}
    assert [got[f"k{i:04d}"] for i in range(500)] == [sum(j % 7 for j in range(i)) for i in range(500)]
    assert sorted(r.m for r in order.number_rows(df, [F.col("seq").desc()], "m", 10).collect()) == list(range(10, 510))
    assert order.number_rows(df.where("false"), [F.col("seq")]).count() == 0
    pages = order.zone_map(df.withColumn("value", F.lit("x")), 100, F.lit(20)).orderBy("page").collect()
    assert [p.entries for p in pages] == [5] * 100 and pages[1].min_key == "k0005"


# --- transactions ----------------------------------------------------------------------------------------------------


def test_replay_and_torn_tail(spark):
    schema = "store string, seq long, kind int, txn_id long, key string"
    df = spark.createDataFrame([("s", 1, 0, 0, "a"), ("s", 2, 2, 7, None), ("s", 3, 0, 7, "b"), ("s", 4, 3, 7, None), ("s", 5, 0, 8, "c"), ("t", 6, 0, 7, "d"), ("s", 7, 1, None, "e"), ("s", 8, 4, 8, None)], schema)
    assert rows(txn.replay(df, ["store"]).select("seq")) == [(1,), (3,), (7,)]
    assert rows(txn.intact_prefix(df, "seq", F.col("seq") != 5).select("seq")) == [(1,), (2,), (3,), (4,)]
    assert txn.intact_prefix(df, "seq", F.lit(True)).count() == 8
    assert rows(txn.intact_prefix(df, "seq", F.when(F.col("seq") < 3, True)).select("seq")) == [(1,), (2,)]


def test_validation(spark):
    df = log(spark, [("a", "1", 1, False), ("a", "2", 9, False), ("b", "1", 2, False)])
    reads = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "none", 0), (4, "a", 1)], "txn_id long, key string, seq_seen long")
    writes = spark.createDataFrame([(1, "x"), (2, "x"), (5, "a")], "txn_id long, key string")
    assert rows(txn.validate(reads, writes, df)) == [(1, 1, 1, 1, "CONFLICT"), (2, 1, 1, 0, "COMMITTED"), (3, 1, 0, 0, "COMMITTED"), (4, 1, 0, 1, "COMMITTED"), (5, 0, 1, 0, "COMMITTED")]
    ops = spark.createDataFrame([(1, "", ""), (2, "k" * 8193, ""), (3, "k", None), (4, None, "")], "txn_id long, key string, value string")
    assert rows(txn.limit_errors(ops)) == [(1, 1, "KEY_EMPTY"), (2, 1, "KEY_TOO_LARGE"), (4, 1, "KEY_EMPTY")]
    own = spark.createDataFrame([("a", "mine", False, 0), ("a", None, True, 1), ("n", "new", False, 2)], "key string, value string, tombstone boolean, ord int")
    assert rows(txn.read_own_writes(df, own, 5)) == [("b", "1", False), ("n", "new", True)]


# --- families, expiry, indexes ---------------------------------------------------------------------------------------


def test_families(spark):
    df = spark.createDataFrame([("f", "k", "1", 1, False), ("f", "k", None, 2, True), ("f", "l", "1", 3, False), ("", "k", "d", 4, False)], "family string, key string, value string, seq long, tombstone boolean")
    assert rows(families.drop_family(df, "f", 4)) == [("f", "l", None, 5, True)]
    assert rows(families.family_counts(df)) == [("", 1, 0), ("f", 1, 1)]
    reg = spark.createDataFrame([('["b","a"]',)], "j string")
    assert [r.name for r in families.list_families(families.parse_catalog(reg, "j")).collect()] == ["a", "b"]


def test_deadlines(spark):
    df = spark.createDataFrame([("a", 100, 1, False), ("a", 300, 2, False), ("b", 100, 3, False), ("c", 100, 4, False), ("c", None, 5, True)], "key string, expire_at_ns long, seq long, tombstone boolean")
    assert rows(ttl.remaining(df, 150)) == [("a", 150), ("b", -50)]
    assert rows(ttl.reap(df, 100)) == [] and rows(ttl.reap(df, 101)) == [("b", 100)]
    data = log(spark, [("a", "1", 1, False), ("b", "1", 1, False), ("z", "1", 1, False)])
    assert rows(ttl.unexpired(data.select("key"), df, 100)) == [("a",), ("z",)]


def test_index_examples(spark):
    head = lambda pk, v: F.array(F.substring(v, 1, 3))
    df = log(spark, [("k:1", "aaa1", 1, False), ("k:2", "bbb", 2, False), ("k:3", "ccc", 3, False), ("k:4", "ddd", 4, False), ("k:5", None, 5, False)])
    built = index.build(df, head)
    assert [r.pk for r in index.between(built, "bbb", "ddd").collect()] == ["k:2", "k:3"]
    assert [r.pk for r in index.point(built, "aaa").collect()] == ["k:1"]
    after = log(spark, [("k:1", "bbb", 9, False), ("k:2", None, 9, True)])
    assert rows(index.changes(df, df.where("key = 'k:9'"), head).select("change").distinct()) == [("REMOVE",)]
    assert ("k:1", "bbb", "ADD") in rows(index.changes(df, after, head)) and ("k:2", "bbb", "REMOVE") in rows(index.changes(df, after, head))
    assert rows(index.consistency(built, df.unionByName(after), head)) == [("aaa", "k:1", "STALE"), ("bbb", "k:1", "MISSING"), ("bbb", "k:2", "STALE")]


# --- filters and cache -----------------------------------------------------------------------------------------------


def plain_positions(key, m, k):
    h = 0xCBF29CE484222325
    for b in key:
        h = (h ^ b) * 0x100000001B3 % 2**64
    g = h ^ 0x9E3779B97F4A7C15
    g = (g ^ g >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    g = (g ^ g >> 27) * 0x94D049BB133111EB % 2**64
    g ^= g >> 31
    return [(h + i * g) % 2**64 % m for i in range(k)]


@pytest.mark.parametrize("most", [1 << 29, 1])
def test_bloom_bits_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MOST_BITS", most)
    assert bloom.size(1000, 0.01) == (9586, 7)
    keys = [b"", b"a", b"\xff" * 300, *[b"k%d" % i for i in range(200)]]
    assert bloom.positions(keys, 997, 5).tolist() == [plain_positions(k, 997, 5) for k in keys]
    assert bloom.positions([], 997, 5).shape == (0, 5)
    stored = spark.createDataFrame([("f", f"k{i}".encode()) for i in range(1000)] + [("g", b"only"), ("f", None)], "file string, key binary")
    built = bloom.build(stored, "file", "key", 9586, 7)
    asked = spark.createDataFrame([("f", f"k{i}".encode()) for i in range(1000)] + [("f", f"n{i}".encode()) for i in range(2000)] + [("none", b"x"), ("g", b"k1")], "file string, key binary")
    passed = {(r.file, bytes(r.key)) for r in bloom.probe(built, asked, 9586, 7).collect()}
    assert all(("f", f"k{i}".encode()) in passed for i in range(1000)) and 0 < len(passed) - 1000 < 60
    words = {r.word: r.bits for r in built.where("file = 'g'").collect()}
    m, k, flat = bloom.from_bytes(bloom.to_bytes(words, 9586, 7))
    assert (m, k) == (9586, 7) and all(int(flat[p // 64]) >> (p % 64) & 1 for p in plain_positions(b"only", m, k))


@pytest.mark.parametrize("q, fp, target, want", [(10, 0, 0.01, 0.01), (200, 50, 0.01, 0.005), (200, 0, 0.01, 0.02), (200, 0, 0.04, 0.05), (200, 200, 0.001, 0.001), (99, 99, 0.5, 0.5), (200, 1, 0.01, 0.01), (0, 0, 0.01, 0.01)])
def test_recommended_rates(spark, q, fp, target, want):
    assert spark.range(1).select(bloom.recommend(F.lit(q), F.lit(fp), F.lit(target))).first()[0] == pytest.approx(want)


def test_telemetry(spark):
    df = spark.createDataFrame([("1", i < 10) for i in range(50)] + [("2", False)] * 2, "file string, is_false_positive boolean")
    assert rows(bloom.telemetry(df)) == [("1", 50, 10, 0.2), ("2", 2, 0, 0.0)]


def test_cache():
    c = cache.AdaptiveCache(16)
    for i in range(100):
        c.put(i, i)
        assert len(c) <= 16
    c.put(99, "new")
    assert c.get(99) == "new" and c.get(0) is None
    c.remove(99)
    assert c.get(99) is None
    ghost = next(iter(c.ghosts["once"]))
    c.put(ghost, 1)
    assert c.p == 1 and ghost in c.live["again"]
    assert cache.AdaptiveCache(0).capacity == 1
    recent = OrderedDict()
    rnd, again, misses = random.Random(1), cache.AdaptiveCache(20), [0, 0]
    for step in range(6000):  # a loop over many keys around a small hot set: recency alone forgets the hot set
        key = rnd.randrange(10) if step % 2 else 100 + step % 400
        for n, hit in enumerate((again.get(key) is not None, key in recent)):
            misses[n] += not hit
        again.put(key, 1) if again.get(key) is None else None
        recent[key] = recent.pop(key, 1)
        if len(recent) > 20:
            recent.popitem(last=False)
    assert misses[0] < misses[1]


def test_simulation(spark):
    trace = spark.createDataFrame([("a", s, k) for s, k in enumerate([1, 2, 1, 3, 2, None])] + [("b", 0, 1)], "cache_id string, step long, key long")
    assert rows(cache.simulate(trace, 2).select("cache_id", "gets", "hits", "resident")) == [("a", 5, 1, 2), ("b", 1, 0, 1)]


# --- shipping --------------------------------------------------------------------------------------------------------


def test_ring_and_resync(spark):
    df = log(spark, [("k", "v", s, False) for s in range(1, 101)])
    assert [r[0] for r in rows(ship.ring_since(df, 97, 10).select("seq"))] == [100, 98, 99]
    assert ship.ring_since(df, 0, 10).count() == 10 and ship.ring(log(spark, []), 10).count() == 0
    followers = spark.createDataFrame([("new", 0), ("near", 90), ("edge", 89), ("there", 100)], "follower string, last_seq long")
    assert {r.follower: r.resync for r in ship.resync_needed(df, followers, 10).collect()} == {"new": True, "near": False, "edge": True, "there": False}


def test_follower_repeats_a_batch(spark, tmp_path):
    schema = "store string, key string, value string, seq long, tombstone boolean, kind int"
    first = spark.createDataFrame([("s", "a", "1", 1, False, 0), ("s", None, None, 2, None, 2), ("s", "b", "1", 3, None, None)], schema)
    late = spark.createDataFrame([("s", "a", "0", 0, False, 0), ("s", "b", None, 4, None, 1), ("s", "a", "1", 1, False, 0)], schema)
    f = ship.Follower(spark, f"file://{tmp_path}", ship.data_records(first).select("store", "key", "value", "seq", "tombstone").schema, ["store"])
    for n, batch in ((0, first), (1, late), (1, late)):
        f.apply(batch, n)
    assert f.records().count() == 5 and rows(f.state().select("key", "value", "seq")) == [("a", "1", 1)]
    leader = spark.createDataFrame([("s", 9), ("t", 4)], "store string, seq long")
    assert rows(ship.lag(leader, f.records(), "store")) == [("s", 9, 4, 5), ("t", 4, 0, 4)]


def test_telemetry_of_filters():
    t = bloom.Telemetry()
    t.record("sst1", 50, 10)
    t.record("sst2")
    t.record("sst2")
    assert t.stats("sst1") == (50, 10) and t.stats("none") is None and t.aggregate() == (52, 10)
    assert t.rate(0.01) == 0.01  # too few to tell
    t.record("sst2", 200, 50)
    assert t.rate(0.01) == 0.005
    t.remove("sst1")
    t.remove("sst2")
    assert t.aggregate() == (0, 0)
    t.record("quiet", 200, 0)
    assert t.rate(0.01) == 0.02 and t.rate(0.04) == bloom.FPR_MAX
    t.record("quiet", 0, 200)
    assert t.rate(0.001) == bloom.FPR_MIN


def test_files_that_may_hold_a_key(spark):
    stored = [(f, f"{f}{i}".encode()) for f in ("a", "b", "c") for i in range(60)] + [("c", b"a7")]
    m, k = bloom.size(61, 0.001)
    filters = bloom.build(spark.createDataFrame(stored, "file string, key binary"), "file", "key", m, k)
    for key, files in ((b"a3", {"a"}), (b"a7", {"a", "c"}), (b"zz", set())):
        assert {r.file for r in bloom.maybe_files(filters, key, m, k).collect()} >= files
    asked = spark.createDataFrame([(f, key) for f in "abc" for key in (b"a3", b"a7", b"zz", b"b59")], "file string, key binary")
    want = {(r.file, bytes(r.key)) for r in bloom.probe(filters, asked, m, k).collect()}
    assert want == {(r.file, key) for key in (b"a3", b"a7", b"zz", b"b59") for r in bloom.maybe_files(filters, key, m, k).collect()}
