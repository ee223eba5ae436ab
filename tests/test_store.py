"""The store against example expectations and a dictionary model."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verslog.operators import bloom, txn
from verslog.operators.scan import Scan
from verslog.sources import backup
from verslog.sources.store import Closed, Config, KeyDeleted, KeyNotFound, RunLost, Store, StoreError, TxnClosed, TxnConflict, TxnTooLarge


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db", Config(l0_runs=2))


def keys(df):
    return [bytes(r.key).decode() for r in df.collect()]


def values(df):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in df.collect()}


def test_put_get_delete(store):
    store.put(b"a", b"1")
    store.put(b"a", b"2")
    assert store.get(b"a") == b"2"
    store.delete(b"nope")
    store.delete(b"a")
    with pytest.raises(KeyDeleted):
        store.get(b"a")
    with pytest.raises(KeyNotFound):
        store.get(b"b")
    store.put(b"e", b"")
    assert store.get(b"e") == b""


def test_snapshots_and_views(store):
    store.put(b"v", b"0")
    s0 = store.snapshot()
    store.put(b"v", b"1")
    s1 = store.snapshot()
    store.put(b"v", b"2")
    store.delete(b"v")
    assert [store.get(b"v", s.seq) for s in (s0, s1)] == [b"0", b"1"]
    store.flush()
    store.compact(to_bottom=True)
    assert [store.get(b"v", s.seq) for s in (s0, s1)] == [b"0", b"1"]
    assert store.seq_at(b"v", s1.seq) == 2
    s0.release()
    s1.retain().release()
    s1.release()
    store.compact(to_bottom=True)
    with pytest.raises((KeyNotFound, KeyDeleted)):
        store.get(b"v")


def test_deletion_in_newer_tier_hides_older_ones(store):
    store.batch([(b"a", b"1"), (b"b", b"1"), (b"c", b"1")])
    store.flush()
    store.compact(to_bottom=True)
    store.delete(b"b")
    store.flush()
    assert keys(store.scan()) == ["a", "c"]
    assert keys(store.scan(reverse=True)) == ["c", "a"]
    store.compact()  # into the middle tier: the tombstone must stay
    assert keys(store.scan()) == ["a", "c"]
    assert keys(store.scan(tombstones=True)) == ["a", "b", "c"]
    store.compact(to_bottom=True)
    assert keys(store.scan(tombstones=True)) == ["a", "c"]
    assert store.vacuum() > 0
    assert keys(store.scan()) == ["a", "c"]


def test_bounds_prefix_and_limit(store):
    store.batch([(k.encode(), b"x") for k in ("a", "b", "c", "d", "e")] + [(b"\xff\x01", b"f"), (b"\xfe\x00", b"g")])
    assert keys(store.scan(lower=b"b", upper=b"d")) == ["b", "c"]
    assert [bytes(r.key) for r in store.prefix_scan(b"\xff").collect()] == [b"\xff\x01"]
    assert [bytes(r.key) for r in store.scan(Scan(reverse=True, limit=2)).collect()] == [b"\xff\x01", b"\xfe\x00"]
    with pytest.raises(ValueError):
        store.prefix_scan(b"")


def test_batches(store):
    store.put(b"del:x", b"old")
    store.batch([(b"del:y", b"new"), (b"del:x", None), (b"k", b"1"), (b"k", b"2")])
    assert values(store.scan()) == {"del:y": "new", "k": "2"}
    before = store.manifest.version
    store.batch([])
    assert store.manifest.version == before
    big = store.spark.range(3000).select(F.format_string("k%06d", "id").alias("key"), F.format_string("v%d", "id").alias("value"), F.lit(False).alias("tombstone"))
    last = store.write(big, ["key"])
    assert last == 3005
    for i in (0, 1000, 2999):
        assert store.get(b"k%06d" % i) == b"v%d" % i
    assert {r.seq for r in store.scan(lower=b"k002999").collect()} == {3005}


def test_transactions(store, spark):
    store.batch([(b"alice", b"1000"), (b"bob", b"500")])
    t = store.begin()
    assert (t.get(b"alice"), t.get(b"bob")) == (b"1000", b"500")
    t.put(b"alice", b"900")
    t.put(b"bob", b"600")
    assert t.get(b"alice") == b"900"
    t.commit()
    assert (store.get(b"alice"), store.get(b"bob")) == (b"900", b"600")
    with pytest.raises(TxnClosed):
        t.commit()
    a = store.begin()
    a.get(b"alice")
    store.put(b"alice", b"v1")
    a.put(b"alice", b"v2")
    with pytest.raises(TxnConflict):
        a.commit()
    assert store.get(b"alice") == b"v1"
    b = store.begin()
    with pytest.raises(KeyNotFound):
        b.get(b"new")
    b.put(b"other", b"1")
    Store(spark, store.folder).put(b"new", b"1")  # another writer
    with pytest.raises(TxnConflict):
        b.commit()
    blind = store.begin()
    store.put(b"alice", b"v3")
    blind.put(b"alice", b"v4")
    blind.commit()
    assert store.get(b"alice") == b"v4"
    c = store.begin()
    with pytest.raises(TxnTooLarge):
        c.put(b"k" * 9000, b"")
    with pytest.raises(TxnTooLarge):
        c.put(b"", b"")
    for i in range(10_000):
        c.put(b"%d" % i, b"")
    with pytest.raises(TxnTooLarge):
        c.put(b"x", b"")
    c.rollback()
    with pytest.raises(TxnClosed):
        c.rollback()


@pytest.mark.parametrize("fold", ["flush", "compact", "bottom"])
def test_a_flush_between_read_and_commit_hides_no_conflict(store, spark, fold):
    store.batch([(b"k", b"%d" % i) for i in range(8)])
    t = store.begin()
    assert t.get(b"k") == b"7"
    other = Store(spark, store.folder, Config(l0_runs=2))  # pins nothing
    other.put(b"k", b"theirs")
    if fold == "bottom":
        other.delete(b"k")
    other.flush()
    if fold != "flush":
        other.compact(to_bottom=fold == "bottom")
    t.put(b"k", b"mine")
    with pytest.raises(TxnConflict):
        t.commit()
    quiet = store.begin()  # what is folded but not changed is no conflict
    store.put(b"other", b"1")
    quiet.get(b"k") if fold != "bottom" else None
    store.flush()
    store.compact()
    quiet.put(b"k", b"next")
    quiet.commit()
    assert store.get(b"k") == b"next"


def test_transactions_over_families_and_counters(store):
    store.create_family("f")
    store.put(b"k", b"in f", "f")
    store.put(b"k", b"in default")
    store.write(store.spark.createDataFrame([(b"null", None, False)], "key binary, value binary, tombstone boolean"))
    t = store.begin()
    assert (t.get(b"k", "f"), t.get(b"k"), t.get(b"null")) == (b"in f", b"in default", None)
    t.put(b"k", b"new", "f")
    t.delete(b"k")
    assert (t.read_count, t.write_count, t.get(b"k", "f")) == (3, 2, b"new")
    with pytest.raises(KeyDeleted):
        t.get(b"k")
    t.commit()
    assert store.get(b"k", family="f") == b"new"
    with pytest.raises(KeyDeleted):
        store.get(b"k")
    a = store.begin()
    a.get(b"k", "f")
    store.put(b"k", b"other family")  # another family's key is another key
    a.put(b"x", b"1")
    a.commit()
    b = store.begin()
    b.get(b"k", "f")
    store.put(b"k", b"changed", "f")
    b.put(b"x", b"2")
    with pytest.raises(TxnConflict):
        b.commit()


def test_the_log_has_transaction_markers_until_it_is_folded(store):
    store.put(b"a", b"1")
    t = store.begin()
    t.put(b"b", b"2")
    t.delete(b"a")
    t.commit()
    log = [(r.kind, r.seq, bytes(r.key) if r.key else None, r.txn_id > 0) for r in store.wal().orderBy("seq", F.col("kind") == 3, F.col("kind") != 2).collect()]
    assert log == [(0, 1, b"a", False), (2, 2, None, True), (0, 2, b"b", True), (1, 3, b"a", True), (3, 3, None, True)]
    assert {(bytes(r.key), r.seq) for r in txn.replay(store.wal(), []).collect()} == {(b"a", 1), (b"b", 2), (b"a", 3)}
    assert sorted((r.seq, r.kind) for r in store.wal(after=2).collect()) == [(3, 1), (3, 3)]
    store.flush()
    assert sorted((r.kind, r.seq) for r in store.wal().collect()) == [(0, 2), (1, 3)]
    assert values(store.scan()) == {"b": "2"}


def test_writes_flush_memory_when_it_is_full(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", Config(mem_runs=3, l0_runs=2))
    for i in range(7):
        store.put(b"k%d" % i, b"v")
    levels = [r.level for r in store.manifest.runs]
    assert levels.count(0) == 1 and len(levels) == 2 and store.manifest.last_seq == 7
    assert keys(store.scan()) == [f"k{i}" for i in range(7)]
    small = Store(spark, f"file://{tmp_path}/small", Config(mem_bytes=1))
    small.put(b"a", b"1")
    assert [r.level for r in small.manifest.runs] == [1]


def test_cleaning_up_while_a_writer_is_between_run_and_commit(store, spark):
    store.put(b"a", b"1")
    other = Store(spark, store.folder)
    at_work = store._write_run

    def write_run(rows, level):
        run = at_work(rows, level)
        other.vacuum()  # spares the young run
        return run

    store._write_run = write_run
    store.put(b"b", b"2")
    assert keys(store.scan()) == ["a", "b"]

    def lose_run(rows, level):
        run = at_work(rows, level)
        other.vacuum(grace_s=-10)
        return run

    store._write_run = lose_run
    with pytest.raises(RunLost):
        store.put(b"c", b"3")
    store._write_run = at_work
    store.put(b"d", b"4")
    assert keys(Store(spark, store.folder).scan()) == ["a", "b", "d"]
    store.flush()
    assert store.vacuum() >= 3 and store.vacuum() == 0
    assert keys(store.scan()) == ["a", "b", "d"] and not store.manifest.retired and not store.manifest.doomed


def test_shared_pins_bind_other_processes(store, spark):
    store.put(b"k", b"1")
    pin = store.snapshot(shared=True)
    other = Store(spark, store.folder)
    other.put(b"k", b"2")
    other.flush()
    other.compact(to_bottom=True)
    store.refresh()
    assert store.get(b"k", pin.seq) == b"1"
    pin.release()
    other.put(b"x", b"1")
    other.flush()
    other.compact(to_bottom=True)
    store.refresh()
    with pytest.raises(KeyNotFound):
        store.get(b"k", pin.seq)


def test_reads_delete_expired_keys_if_asked_to(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", Config(lazy_expiry=True))
    store.put_until(b"k", b"v", 100)
    assert store.get(b"k", now_ns=99) == b"v"
    with pytest.raises(KeyNotFound):
        store.get(b"k", now_ns=100)
    with pytest.raises(KeyDeleted):
        store.get(b"k")
    with pytest.raises(KeyNotFound):
        store.ttl_of(b"k", 100)
    store.put_until(b"k", b"v", 100)
    Store(spark, store.folder).put_until(b"k", b"renewed", 500)  # between the read and the deletion
    with pytest.raises(KeyNotFound):
        store.get(b"k", now_ns=100)
    store.refresh()
    assert store.get(b"k", now_ns=100) == b"renewed"


def test_filters_of_files_and_their_telemetry(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", Config(filters=True, target_file_bytes=4000))
    rows = spark.range(400).select(F.format_string("k%04d", F.col("id") * 2).alias("key"), F.lit("v").alias("value"))
    store.write(rows, ["key"])
    store.flush()
    (run,) = store.manifest.runs
    assert run.filter is not None and store.telemetry.aggregate() == (0, 0)
    assert store.get(b"k0400") == b"v"
    queries, wrong = store.telemetry.stats(run.path)
    assert queries == wrong + 1
    with pytest.raises(KeyNotFound):
        store.get(b"k0401")
    store.put(b"k0400", b"new")
    store.delete(b"k0402")
    store.flush()
    assert store.get(b"k0400") == b"new"
    with pytest.raises(KeyDeleted):
        store.get(b"k0402")
    assert Store(spark, store.folder).get(b"k0798") == b"v"  # another process reads the filters too
    before = bloom.positions([b"x"], *run.filter).shape[1]
    store.telemetry.record(run.path, 200, 150)  # too many wrong answers: the next filters are larger
    old = run.path
    store.compact()
    (run,) = store.manifest.runs
    assert store.telemetry.stats(old) is None and run.filter[1] > before
    store.compact(to_bottom=True)
    assert store.get(b"k0404") == b"v" and len(keys(store.scan())) == 399
    store.vacuum()
    assert store.get(b"k0406") == b"v"


def test_two_writers_get_different_seqs(store, spark):
    other = Store(spark, store.folder)
    store.put(b"a", b"1")
    other.put(b"b", b"1")
    store.put(b"a", b"2")
    store.refresh()
    assert sorted(r.seq for r in store.log().collect()) == [1, 2, 3]
    assert Store(spark, store.folder).get(b"a") == b"2"


def test_a_torn_manifest_is_no_commit(store, spark):
    store.put(b"a", b"1")
    at = store.folder[len("file://") :] + f"/manifests/{store.manifest.version + 1:020d}.json"
    with open(at, "w") as f:
        f.write('{"version": 2')
    again = Store(spark, store.folder)
    assert again.get(b"a") == b"1"
    again._log.grace_s = -1  # the writer is taken for dead
    again.put(b"a", b"2")
    assert Store(spark, store.folder).get(b"a") == b"2"


def test_families(store):
    store.create_family("cf1")
    store.create_family("cf1")
    store.create_family("cf2")
    store.put(b"shared", b"v1", "cf1")
    store.put(b"shared", b"v2", "cf2")
    store.put_until(b"t", b"x", 100, "cf1")
    assert (store.get(b"shared", family="cf1"), store.get(b"shared", family="cf2")) == (b"v1", b"v2")
    with pytest.raises(KeyNotFound):
        store.get(b"shared")
    assert store.families() == ["cf1", "cf2"]
    assert keys(store.prefix_scan(b"", "cf1")) == ["shared", "t"]
    store.drop_family("cf1")
    assert store.families() == ["cf2"]
    assert keys(store.scan(family="cf1")) == []
    with pytest.raises(StoreError):
        store.drop_family("cf1")
    for bad in ("", "a\x00b"):
        with pytest.raises(ValueError):
            store.create_family(bad)


def test_expiry(store):
    store.put_with_ttl(b"k", b"v1", 30, now_ns=1000)
    assert store.get(b"k", now_ns=1029) == b"v1"
    with pytest.raises(KeyNotFound):
        store.get(b"k", now_ns=1030)
    assert store.ttl_of(b"k", 1040) == -10
    store.put_with_ttl(b"k", b"v2", 10_000, now_ns=1000)
    assert store.get(b"k", now_ns=1060) == b"v2"
    store.put(b"plain", b"1")
    with pytest.raises(KeyNotFound):
        store.ttl_of(b"plain", 0)
    store.expire_at(b"plain", 2000)
    assert keys(store.scan(now_ns=2000)) == ["k"]
    assert keys(store.scan()) == ["k", "plain"]
    store.reap(2000)
    assert store.get(b"plain") == b"1"  # a sweep takes only what is strictly over
    store.reap(2001)
    with pytest.raises(KeyDeleted):
        store.get(b"plain")
    for bad in (0, -1):
        with pytest.raises(ValueError):
            store.put_with_ttl(b"x", b"", bad, 0)


def test_indexes(store):
    parts = lambda pk, v: F.split(v.cast("string"), ":")
    store.define_index("by_part", parts)
    for k, v in ((b"u:1", b"ann:admin"), (b"u:2", b"bob:user"), (b"u:3", b"cid:admin")):
        store.put_indexed(k, v)
    pks = lambda df: [bytes(r.pk).decode() for r in df.collect()]
    assert pks(store.query_index("by_part", b"admin")) == ["u:1", "u:3"]
    assert pks(store.query_index("by_part", b"none")) == [] == pks(store.query_index("unknown", b"x"))
    assert pks(store.range_index("by_part", b"admin", b"cid")) == ["u:1", "u:3", "u:1", "u:2"]
    store.put_indexed(b"u:1", b"ann:user")
    assert pks(store.query_index("by_part", b"admin")) == ["u:3"]
    store.delete_indexed(b"u:2")
    assert pks(store.query_index("by_part", b"user")) == ["u:1"]
    store.put(b"u:9", b"zed:admin")  # a plain write leaves the index as it is
    assert pks(store.query_index("by_part", b"admin")) == ["u:3"]
    store.rebuild_index("by_part")
    assert pks(store.query_index("by_part", b"admin")) == ["u:3", "u:9"]
    store.flush()
    store.compact(to_bottom=True)
    assert pks(store.range_index("by_part", b"user", None)) == ["u:1", "u:9"]
    store.drop_index("by_part")
    assert pks(store.query_index("by_part", b"admin")) == []
    assert store.get(b"u:9") == b"zed:admin"
    with pytest.raises(StoreError):
        store.rebuild_index("by_part")


def test_backup_and_restore(store, spark, tmp_path):
    store.batch([(b"bk:%04d" % i, b"v%d" % i) for i in range(100)])
    made = store.backup(f"{tmp_path}/copy", "2025-01-01T00:00:00Z")
    assert made["version"] == 1 and made["snap_seq"] == 100 and backup.read_manifest(f"{tmp_path}/copy") == made
    backup.restore(spark, f"{tmp_path}/copy", f"{tmp_path}/again")
    again = Store(spark, f"file://{tmp_path}/again")
    assert again.scan().count() == 100 and again.get(b"bk:0042") == b"v42"
    with pytest.raises(backup.BackupError, match="empty"):
        backup.restore(spark, f"{tmp_path}/copy", f"{tmp_path}/again")
    at = f"{tmp_path}/copy/{[f['name'] for f in made['files'] if f['name'].startswith('runs')][0]}"
    raw = bytearray(open(at, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(at, "wb").write(raw)
    with pytest.raises(backup.BackupError, match="SHA256"):
        backup.restore(spark, f"{tmp_path}/copy", f"{tmp_path}/third")
    bad = made | {"files": [{"name": "../x", "size": 1, "sha256": ""}]}
    open(f"{tmp_path}/copy/{backup.MANIFEST}", "w").write(json.dumps(bad))
    with pytest.raises(backup.BackupError, match="leads out"):
        backup.restore(spark, f"{tmp_path}/copy", f"{tmp_path}/third")
    open(f"{tmp_path}/copy/{backup.MANIFEST}", "w").write(json.dumps(made | {"version": 2}))
    with pytest.raises(backup.BackupError, match="version"):
        backup.read_manifest(f"{tmp_path}/copy")


def test_closed_and_read_only(store, spark):
    store.put(b"a", b"1")
    store.close()
    store.close()
    with pytest.raises(Closed):
        store.put(b"a", b"2")
    reader = Store(spark, store.folder, read_only=True)
    assert reader.get(b"a") == b"1"
    with pytest.raises(StoreError):
        reader.put(b"a", b"2")


ops = st.lists(st.tuples(st.sampled_from(["put", "put", "del", "flush", "compact", "bottom", "snap"]), st.sampled_from([b"", b"a", b"ab", b"\xff", b"z"]), st.sampled_from([b"", b"1", b"2"])), min_size=3, max_size=9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops)
def test_random_operations_follow_a_dictionary(spark, tmp_path_factory, history):
    store, model, snaps = Store(spark, f"file://{tmp_path_factory.mktemp('model')}/db", Config(l0_runs=2)), {}, []
    for what, key, value in history:
        if what == "put":
            store.put(key, value)
            model[key] = value
        elif what == "del":
            store.delete(key)
            model.pop(key, None)
        elif what == "snap":
            snaps.append((store.snapshot(), dict(model)))
        else:
            store.flush() if what == "flush" else store.compact(to_bottom=what == "bottom")
    got = lambda **o: [(bytes(r.key), bytes(r.value)) for r in store.scan(**o).collect()]
    assert got() == sorted(model.items())
    assert got(reverse=True) == sorted(model.items(), reverse=True)
    for snap, then in snaps:
        if snap.seq:
            assert got(snapshot=snap.seq) == sorted(then.items())
