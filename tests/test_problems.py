"""Ledger, copy diff, message dedup, change feed and snapshot diff: edge cases, skew and brute force."""

import datetime as dt
import os
import random
import time
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from verslog.functions.hashing import maybe_in
from verslog.operators import assignment
from verslog.operators.assignment import pair_rows
from verslog.operators.changes import effective_changes, latest_by_window, newest_first
from verslog.operators.dedup import SeenRanges, drop_repeats, merge_ranges
from verslog.operators.diff import diff_copies
from verslog.operators.ledger import StaleLease, WorkLedger, item_states, next_items, settle_leases, work
from verslog.operators.snapshots import snapshot_changes


def at(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- ledger ----------------------------------------------------------------------------------------------------------

ITEM, LEASE, REPORT = "scope string, position long, seen_at timestamp", "scope string, token long, upto long, taken_at timestamp, expires_at timestamp", "scope string, token long, reported_at timestamp, ok boolean"


def ledger(spark, items, leases, reports, now=None, **kw):
    settled = settle_leases(spark.createDataFrame([(s, t, u, at(a), at(e)) for s, t, u, a, e in leases], LEASE), spark.createDataFrame([(s, t, at(a), ok) for s, t, a, ok in reports], REPORT), now)
    return item_states(spark.createDataFrame([(s, p, at(a)) for s, p, a in items], ITEM), settled, **kw)


def test_ledger_states(spark):
    items = [("a", 1, 0), ("a", 5, 0), ("a", 5 + 10, 0), ("a", 2, 30), ("a", 3, None), (None, 1, 0), ("a", None, 0), ("b", 1, 0)]
    leases = [("a", 1, 5, 10, 12), ("a", 1, 5, 10, 12), ("a", 2, 20, 20, 60), ("a", 3, None, 21, 60)]
    reports = [("a", 1, 11, True), ("a", 1, 11, True), ("a", 2, 25, None)]
    got = {(r.scope, r.position, r.seen_at): r.state for r in ledger(spark, items, leases, reports, F.lit(at(40))).collect()}
    assert got == {("a", 1, at(0)): "done", ("a", 5, at(0)): "done", ("a", 15, at(0)): "leased", ("a", 2, at(30)): "pending", ("a", 3, None): "pending", (None, 1, at(0)): "pending", ("a", None, at(0)): "pending", ("b", 1, at(0)): "pending"}
    over = ledger(spark, items, leases, reports, F.lit(at(61)))
    assert {r.state for r in over.where("position = 15").collect()} == {"pending"}
    assert rows(next_items(over.where("scope = 'a'"), 10, F.lit(at(61)))) == [("a", 2, at(30))]


def test_ledger_rejects_stale_reports(spark):
    leases = [("a", 1, 9, 0, 5), ("a", 2, 9, 10, 20)]
    late = [("a", 1, 15, True)]
    assert {r.state for r in ledger(spark, [("a", 1, 0)], leases, late).collect()} == {"pending"}
    assert {r.state for r in ledger(spark, [("a", 1, 0)], leases, [("a", 1, 9, True)]).collect()} == {"done"}


def test_ledger_empty(spark):
    assert ledger(spark, [], [], []).count() == 0
    assert rows(ledger(spark, [("a", 1, 0)], [], []).select("state")) == [("pending",)]


@pytest.mark.parametrize("bucket", [4, 1 << 16])
def test_ledger_brute_force(spark, bucket):
    rnd = random.Random(bucket)
    items = [(rnd.choice("hhhhab"), p, rnd.choice([None, rnd.randrange(50)])) for p in range(120)]
    leases = [(rnd.choice("hhab"), t, rnd.randrange(130), t, t) for t in range(40)]
    reports = [(s, t, t, rnd.random() < 0.5) for s, t, *_ in leases]
    ok = {(s, t) for s, t, _, good in reports if good}
    want = sorted(((s, p) for s, p, seen in items if not any(ls == s and (ls, t) in ok and up >= p and seen is not None and taken >= seen for ls, t, up, taken, _ in leases)), key=repr)
    assert rows(ledger(spark, items, leases, reports, bucket=bucket).where("state = 'pending'").select("scope", "position")) == want


def test_work_ledger(spark, tmp_path):
    a, b = WorkLedger(spark, f"file://{tmp_path}"), WorkLedger(spark, f"file://{tmp_path}")
    assert a.add(["u1", "u2", "u1"]) == 2 and b.add(["u1"]) == 0
    (x,) = a.lease(1, now=0, seconds=10)
    (y,) = b.lease(5, now=1, seconds=10)
    assert (x.unit, y.unit) == ("u1", "u2") and a.lease(1, now=2, seconds=10) == []
    (again,) = b.lease(5, now=10.5, seconds=10)  # the first worker is late
    assert (again.unit, again.token) == ("u1", 2) and again.path != x.path  # the late worker can't touch the other's output
    with pytest.raises(StaleLease):
        a.complete(x)
    b.complete(again)
    b.complete(again)
    a.release(x)
    b.release(y)
    assert WorkLedger(spark, f"file://{tmp_path}").states() == {"u1": "done", "u2": "pending"}
    assert a.outputs() == {"u1": again.path}


def test_work_ledger_checkpoints(spark, tmp_path):
    a = WorkLedger(spark, f"file://{tmp_path}", checkpoint_every=3)
    a.add([f"u{i}" for i in range(5)])
    for _ in range(4):
        (lease,) = a.lease(1, now=0, seconds=10)
        a.complete(lease)
    for n in range(1, 7):
        (tmp_path / f"commits/{n:020d}.json").unlink()  # what a checkpoint holds isn't read again
    b = WorkLedger(spark, f"file://{tmp_path}", checkpoint_every=3)
    assert b.states() == a.states() == {f"u{i}": "done" if i < 4 else "pending" for i in range(5)}
    assert b.outputs() == a.outputs() and len(b.outputs()) == 4
    (lease,) = b.lease(5, now=0, seconds=10)
    assert lease.unit == "u4" and a.lease(5, now=1, seconds=10) == []


def test_a_stale_worker_leaves_the_finished_output_alone(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}")
    ledger.add(["u"])
    (slow,) = ledger.lease(1, now=0, seconds=10)
    (quick,) = ledger.lease(1, now=11, seconds=10)
    spark.range(3).write.mode("overwrite").parquet(quick.path)
    ledger.complete(quick)
    spark.range(7).write.mode("overwrite").parquet(slow.path)
    with pytest.raises(StaleLease):
        ledger.complete(slow)
    assert spark.read.parquet(*ledger.outputs().values()).count() == 3


def test_work_is_done_once_in_spite_of_failures(spark, tmp_path):
    ledger, other, now = WorkLedger(spark, f"file://{tmp_path}/l"), WorkLedger(spark, f"file://{tmp_path}/l"), [0.0]
    ledger.add(["a", "b", "c"])
    tries = {}

    def process(lease):
        tries[lease.unit] = tries.get(lease.unit, 0) + 1
        spark.range(3).write.mode("overwrite").parquet(lease.path)
        if lease.unit == "b" and tries["b"] == 1:
            raise RuntimeError("lost after the write")
        if lease.unit == "c" and tries["c"] == 1:  # too slow: another worker takes the unit and finishes it
            now[0] = 100.0
            assert work(other, process, lambda: now[0], 50) == (["b", "c"], {})

    done, failed = work(ledger, process, lambda: now[0], 50)
    assert done == ["a"] and list(failed) == ["b"]
    assert ledger.states() == {"a": "done", "b": "done", "c": "done"} and tries == {"a": 1, "b": 2, "c": 2}
    assert list(ledger.outputs()) == ["a", "b", "c"] and spark.read.parquet(*ledger.outputs().values()).count() == 9
    assert work(ledger, process, lambda: 200.0, 50) == ([], {})


# --- differences of copies -------------------------------------------------------------------------------------------

FILES = "id long, name string, size long, sha string, difference string"


def diff(spark, left, right, **kw):
    frame = lambda x: spark.createDataFrame([(*r, "clash") for r in x], FILES)
    return rows(diff_copies(frame(left), frame(right), ["id", "name"], ["size", "sha"], ("p", "r"), {"sha": F.lower}, **kw))


def test_diff_cases(spark):
    left = [(1, "a", 1, "AB"), (1, "a", 1, "AB"), (2, "b", None, "x"), (3, "c", 3, "y"), (None, "n", 1, None), (5, None, 1, ""), (6, "only", 1, "z")]
    right = [(1, "a", 1, "ab"), (2, "b", 0, "x"), (3, "c", 4, "w"), (None, "n", 1, None), (5, None, 1, None), (7, "other", 1, "z"), (7, "other", 1, "z")]
    want = [(2, "b", "size"), (3, "c", "sha"), (3, "c", "size"), (5, None, "sha"), (6, "only", "missing_in_r"), (7, "other", "missing_in_p")]
    assert diff(spark, left, right) == sorted(want, key=repr)
    assert diff(spark, left, right, extra_copies=True) == sorted([*want, (1, "a", "extra_in_p")], key=repr)
    assert diff(spark, [], []) == []
    assert diff(spark, [(1, "a", 1, "x")], []) == [(1, "a", "missing_in_r")]


def test_diff_pairs_several_rows_of_a_key(spark):
    left = [(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "a", 3, "z")]
    assert diff(spark, left, [(1, "a", 2, "q"), (1, "a", 3, "z"), (1, "a", 1, "x")]) == [(1, "a", "sha")]
    assert diff(spark, left, [(1, "a", 2, "x"), (1, "a", 3, "y"), (1, "a", 4, "z")]) == [(1, "a", "size")]


def test_diff_hot_key(spark):
    many = [(1, "hot", i % 3, "x") for i in range(3000)]
    assert diff(spark, many, many + [(1, "hot", 7, "x")], extra_copies=True) == [(1, "hot", "extra_in_r")]


def test_large_pairing_is_least_and_quick(monkeypatch):
    rng = np.random.default_rng(2)
    cost = lambda a, b, pairs: sum((a[i] != b[j]).sum() for i, j in pairs)
    for f in (1, 2, 3, 4):
        a, b = rng.integers(0, 12, (90, f)), rng.integers(0, 12, (70, f))
        dense = pair_rows(a, b)
        monkeypatch.setattr(assignment, "DENSE_PAIRS", 0)
        sparse = pair_rows(a, b)
        monkeypatch.undo()
        assert cost(a, b, dense) == cost(a, b, sparse) and len(sparse) == 70 == len({i for i, _ in sparse}) == len({j for _, j in sparse})
    a, b = (np.column_stack([rng.integers(0, 8000, 20_000), rng.integers(0, 3, 20_000)]) for _ in range(2))
    began = time.time()
    assert len(pair_rows(a, b)) == 20_000 and time.time() - began < 60


def differing(a, b):
    return tuple(np.sum([a[i] != b[j] for i, j in pair_rows(a, b)], axis=0)) if len(a) and len(b) else ()


@pytest.mark.parametrize("fields", [1, 2, 3, 8, 9])
def test_ties_are_broken_by_fields_whatever_the_order_and_the_way(monkeypatch, fields):
    rng = np.random.default_rng(fields)
    for size in (2, 3, 5, 9, 30):
        a, b = rng.integers(0, 3, (size, fields)), rng.integers(0, 3, (size + int(rng.integers(0, 3)), fields))
        want = differing(a, b)
        for dense in (10**9, size * size, size * size - 1, 0) if fields < 8 else (10**9, 0):
            monkeypatch.setattr(assignment, "DENSE_PAIRS", dense)
            assert differing(rng.permutation(a), rng.permutation(b)) == want
        if size <= 5:
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            each = ([small[i] != large[j] for i, j in enumerate(p)] for p in permutations(range(len(large)), len(small)))
            assert want == min((int(np.sum(e)), *np.sum(e, axis=0)) for e in each)[1:]


def test_diff_is_the_same_under_shuffled_rows(spark):
    left, right = [(1, "a", 0, "0"), (1, "a", 1, "1")], [(1, "a", 0, "1"), (1, "a", 1, "0")]
    assert {tuple(diff(spark, x, y)) for x in (left, left[::-1]) for y in (right, right[::-1])} == {((1, "a", "sha"),)}


@pytest.mark.parametrize("dense", [10**9, 0])
def test_pairing_is_least(monkeypatch, dense):
    monkeypatch.setattr(assignment, "DENSE_PAIRS", dense)
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m, f = rng.integers(1, 5), rng.integers(1, 6), rng.integers(1, 4)
        a, b = rng.integers(0, 4, (n, f)), rng.integers(0, 4, (m, f))
        pairs = pair_rows(a, b)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        small, large = (a, b) if n <= m else (b, a)
        least = min(sum((small[i] != large[j]).sum() for i, j in enumerate(p)) for p in permutations(range(len(large)), len(small)))
        assert sum((a[i] != b[j]).sum() for i, j in pairs) == least


# --- messages delivered more than once -------------------------------------------------------------------------------

WAL = "delivery_id long, store string, seq long, txn_id long, key string, first string, batch_id long"


def repeats(messages):
    seen, out = set(), []
    for d, *ident in sorted(messages):
        if tuple(ident) in seen:
            out.append(d)
        seen.add(tuple(ident))
    return [(d,) for d in out]


def wal(spark, messages):
    return spark.createDataFrame([(*m, "clash", 0) for m in messages], WAL)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_repeats_brute_force(spark, batches):
    rnd = random.Random(batches)
    messages = [(d, rnd.choice(["h", "h", "h", "b", None]), rnd.choice([None, rnd.randrange(60)]), rnd.choice([0, None, 1]), rnd.choice(["", None, "k", "k"])) for d in range(900)]
    assert rows(drop_repeats(wal(spark, messages), "store", "seq", ["txn_id", "key"], "delivery_id", batches)) == sorted(repeats(messages), key=repr)


def test_repeats_edge_cases(spark):
    assert drop_repeats(wal(spark, []), "store", "seq", ["txn_id", "key"], "delivery_id").count() == 0
    long_key = "x" * 100_000
    messages = [(1, "s", 1, None, long_key), (2, "s", 1, 0, long_key), (3, "s", 1, None, long_key), (9, "s", -5, 0, None), (10, "s", -5, 0, None)]
    assert rows(drop_repeats(wal(spark, messages), "store", "seq", ["txn_id", "key"], "delivery_id")) == [(10,), (3,)]
    hot = [(d, "s", 7, 0, "k") for d in range(2000)]
    assert drop_repeats(wal(spark, hot), "store", "seq", ["txn_id", "key"], "delivery_id", 3).count() == 1999


def test_seen_ranges_are_merged(spark):
    seen = SeenRanges(spark, "store", "seq", ["txn_id", "key"], "delivery_id", bucket=100)
    first = [(d, "s", n, 0, "k") for d, n in enumerate([1, 2, 3, 7, 150])]
    assert seen.apply(wal(spark, first)).count() == 0
    assert rows(seen.ranges()) == [("s", 1, 3), ("s", 150, 150), ("s", 7, 7)]
    second = [(d + 10, "s", n, 0, "k") for d, n in enumerate([2, 4, 5, 6, 7])] + [(20, "s", 3, 9, "k"), (21, "s", 3, 9, "k")]
    assert rows(seen.apply(wal(spark, second))) == [(10,), (14,), (21,)]
    assert rows(seen.ranges()) == [("s", 1, 7), ("s", 150, 150)]
    assert rows(seen.apply(wal(spark, [(30, "s", 3, 9, "k"), (31, "s", 3, 8, "k")]))) == [(30,)]
    seen.close()


def test_seen_ranges_survive_a_restart(spark, tmp_path):
    make = lambda: SeenRanges(spark, "store", "seq", ["txn_id", "key"], "delivery_id", folder=f"file://{tmp_path}/seen")
    first, second = [(1, "s", 1, 0, "k"), (2, "s", 1, 0, "k"), (3, None, 1, 0, "k")], [(4, "s", 1, 0, "k"), (5, None, 1, 0, "k"), (6, "s", 2, 0, "k")]
    assert rows(make().apply(wal(spark, first), 10)) == [(2,)]
    assert rows(make().apply(wal(spark, first), 10)) == [(2,)]  # repeated after its commit
    os.makedirs(f"{tmp_path}/seen/step-{11:012d}/numbers")  # left by an attempt that failed
    assert rows(make().apply(wal(spark, second), 11)) == [(4,), (5,)]
    assert rows(make().apply(wal(spark, second), 11)) == [(4,), (5,)]
    assert rows(make().ranges()) == [("s", 1, 2)]
    with pytest.raises(ValueError):
        make().apply(wal(spark, second), 9)


def test_merge_ranges():
    lo, hi = merge_ranges(np.array([5, 1, 2, 9]), np.array([6, 1, 4, 9]))
    assert (lo.tolist(), hi.tolist()) == ([1, 9], [6, 9])


# --- change feed -----------------------------------------------------------------------------------------------------

FEED = "store string, kind tinyint, seq long, txn_id long, key string, value string, tombstone boolean"


def state_of(feed, base=()):
    commits = {(s, t) for s, k, _, t, *_ in feed if k == 3}
    best = {}
    for s, k, n, t, key, v, dead in feed:
        if key is None or k not in (0, 1, None) or (t and (s, t) not in commits):
            continue
        row = (n, k == 1 or bool(dead), v is not None, v)
        if (s, key) not in best or row[:3] + (row[3] or "",) > best[s, key][:3] + (best[s, key][3] or "",):
            best[s, key] = row
    out = {k: (n, v) for k, (n, dead, _, v) in best.items() if not dead}
    out |= {(s, k): (n, v) for s, k, n, v in base if (s, k) not in best}
    return sorted(((s, k, n, v) for (s, k), (n, v) in out.items()), key=repr)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_feed_brute_force(spark, batches):
    rnd = random.Random(batches)
    feed = [(rnd.choice(["a", "a", "b", None]), rnd.choice([0, 0, 0, 1, 2, 3, 4, None]), rnd.randrange(300), rnd.choice([0, None, rnd.randrange(1, 40)]), rnd.choice(["h", "h", "h", None, "", f"k{rnd.randrange(40)}"]), rnd.choice([None, "", "v"]), rnd.choice([True, False, False, None])) for _ in range(1500)]
    feed = [f for f in feed if not (f[0] is None and f[1] == 3)]  # a marker without a store commits nothing
    df = effective_changes(spark.createDataFrame(feed, FEED))
    base = [("a", "k1", -1, "old"), ("a", "untouched", -1, None), ("b", "h", -1, "old")]
    got = newest_first(df, ["store", "key"], keep=["value"], batches=batches, base=spark.createDataFrame(base, "store string, key string, seq long, value string"))
    assert rows(got.select("store", "key", "seq", "value")) == state_of(feed, base)
    assert rows(newest_first(df, ["store", "key"], batches=batches)) == [r[:3] for r in state_of(feed)]


def test_feed_edge_cases(spark):
    empty = spark.createDataFrame([], FEED)
    assert newest_first(effective_changes(empty), ["store", "key"]).count() == 0
    hot = [("s", 0, n, 0, "hot", str(n), False) for n in range(3000)] + [("s", 1, 3000, 0, "hot", None, True)]
    assert newest_first(effective_changes(spark.createDataFrame(hot, FEED)), ["store", "key"]).count() == 0
    clash = spark.createDataFrame([("s", 0, 1, 0, "a", "1", False), ("s", 1, 2, 0, "b", "1", None)], FEED).withColumns({c: F.lit("clash") for c in ("deleted", "m", "__m", "n", "k")})
    assert rows(newest_first(effective_changes(clash), ["store", "key"], keep=["value", "m"])) == [("s", "a", 1, "1", "clash")]
    unnumbered = spark.createDataFrame([("s", 0, None, 0, "a", "1", False), ("s", 0, None, 0, "b", "1", False), ("s", 1, None, 0, "b", None, None), ("s", 0, None, 0, "c", "1", False), ("s", 1, 5, 0, "c", None, None)], FEED)
    for keep in ([], ["value"]):
        assert rows(newest_first(effective_changes(unnumbered), ["store", "key"], keep=keep).select("key", "seq")) == [("a", None)]
    one = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "key string, seq long")
    assert rows(latest_by_window(one, ["key"])) == [("a", 2), (None, 3)]


# --- snapshots -------------------------------------------------------------------------------------------------------

SNAP = "scope string, snapshot long, taken_at timestamp, files array<struct<name:string,size:long,sha:string>>, key string"


def changes(spark, snaps, **kw):
    df = spark.createDataFrame([(s, i, at(t), None if f is None else [(n, 1, h) for n, h in f], "clash") for s, i, t, f in snaps], SNAP)
    return rows(snapshot_changes(df, "files", lambda f: f["name"], lambda f: F.lower(f["sha"]), **kw))


def test_snapshot_cases(spark):
    snaps = [
        ("a", 1, 0, [("x", "A"), ("y", "b"), (None, "n")]), ("a", 1, 0, [("y", "b"), ("x", "A"), (None, "n")]),
        ("a", 3, 5, [("x", "a"), ("y", None), ("z", ""), ("z", "")]), ("a", 2, 9, []), ("a", 4, 10, None), ("b", 5, 0, [("x", "1")]), ("a", None, 7, [("q", "1")]), ("b", 6, 1, [("x", "2")]),
    ]
    want = [(3, "y", "changed"), (3, "z", "added"), (3, None, "removed"), (2, "x", "removed"), (2, "y", "removed"), (2, "z", "removed"), (6, "x", "changed")]
    assert changes(spark, snaps) == sorted(want, key=repr)
    assert changes(spark, []) == []
    assert changes(spark, snaps[:1]) == []


def test_snapshots_brute_force(spark):
    rnd = random.Random(4)
    snaps, want = [], []
    for scope in ("h", "h2", "c"):
        last = None
        for t in range(8 if scope == "h" else 3):
            number = len(snaps)
            files = {f"f{rnd.randrange(400)}": rnd.choice(["a", "A", "b", None]) for _ in range(300 if scope == "h" else 5)}
            snaps.append((scope, number, t, list(files.items())))
            low = {k: v and v.lower() for k, v in files.items()}
            if last is not None:
                want += [(number, k, "added") for k in low.keys() - last.keys()] + [(number, k, "removed") for k in last.keys() - low.keys()]
                want += [(number, k, "changed") for k in low.keys() & last.keys() if low[k] != last[k]]
            last = low
    assert changes(spark, snaps, buckets=7) == sorted(want, key=repr)




@pytest.mark.parametrize("keep", [None, ["value"]])
def test_changes_at_the_ends_of_the_range_of_numbers(spark, keep):
    top, low = 2**63 - 1, -(2**63)
    feed = [("s", "a", top, False, "1"), ("s", "a", top - 1, True, None), ("s", "b", top - 1, False, "2"), ("s", "b", top, True, None), ("s", "c", low, False, "3"), ("s", "c", None, True, None), ("s", "d", None, False, "4"), ("s", "e", top, False, "5"), ("s", "e", top, True, None), ("s", "f", None, True, None), ("s", "f", None, False, "6")]
    df = spark.createDataFrame(feed, "store string, key string, seq long, deleted boolean, value string")
    got = newest_first(df, ["store", "key"], keep=keep, cuts=[0, 2**62])
    assert rows(got.select("key", "seq")) == [("a", top), ("c", low), ("d", None)]


def test_state_of_many_small_batches_is_folded(spark, tmp_path):
    seen = SeenRanges(spark, "store", "seq", ["txn_id", "key"], "delivery_id", bucket=4, folder=f"file://{tmp_path}/seen", fold=3)
    rnd, known, n = random.Random(5), set(), 0
    for step in range(6):
        batch, want = [], set()
        for _ in range(12):
            n += 1
            ident = (rnd.choice(["s", "t", None]), rnd.choice([None, *range(step, step + 9)]), rnd.choice([0, 0, 0, 1]), rnd.choice("kkkj"))
            batch.append((n, *ident))
            want |= {n} if ident in known else set()
            known.add(ident)
        assert {r.delivery_id for r in seen.apply(wal(spark, batch)).collect()} == want
    assert len(seen._parts(seen._steps())) < 3
    touched = spark.read.parquet(f"file://{tmp_path}/seen/step-{5:012d}/numbers").where("kind = 1").select("bucket").distinct()
    assert {r.bucket for r in touched.collect()} <= {1, 2, 3}


def test_only_candidates_pass_the_filter(spark):
    digests = spark.range(20000).select(F.xxhash64("id").alias("h"), "id")
    wanted = digests.where("id % 100 = 0")
    got = {r.id for r in maybe_in(digests, F.col("h"), wanted.select(F.col("h").alias("w")), F.col("w"), words=1024).collect()}
    assert got >= set(range(0, 20000, 100)) and len(got) < 800
    assert maybe_in(digests, F.col("h"), wanted.where("false").select(F.col("h").alias("w")), F.col("w")).count() == 0
