"""Leader, followers, maintenance and backups to other file systems."""

import pytest
from pyspark.sql import functions as F

from verslog.operators import merge
from verslog.sources import backup
from verslog.sources.store import Config, KeyDeleted, Store, StoreError
from verslog.streaming import ship


def state(follower):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in follower.state().collect()}


def test_leader_and_follower(spark, tmp_path):
    at = f"file://{tmp_path}"
    store = Store(spark, f"{at}/db", Config(l0_runs=1))
    config = ship.Replication("follower", f"{at}/shipped")
    leader = ship.replicate(store, ship.Replication("leader", f"{at}/shipped"))
    follower = ship.replicate(Store(spark, f"{at}/copy"), config)
    assert leader.ship() == 0 and state(follower) == {} and follower.last_seq() == 0
    store.batch([(b"rep:%02d" % i, b"v%d" % i) for i in range(20)])
    assert leader.ship() == 20 == leader.ship()
    ship.follow_leader(follower, config)
    assert state(follower) == {f"rep:{i:02d}": f"v{i}" for i in range(20)} and follower.last_seq() == 20
    t = store.begin()
    t.delete(b"rep:00")
    t.put(b"rep:01", b"new")
    t.commit()
    store.flush()
    store.compact(to_bottom=True)  # the pin of what was shipped keeps the deletion
    assert leader.ship() == 22
    follower.compact()
    ship.follow_leader(follower, config)
    want = {f"rep:{i:02d}": f"v{i}" for i in range(2, 20)} | {"rep:01": "new"}
    assert state(follower) == want
    follower.compact()
    assert state(follower) == want and follower._batches() == []
    follower.apply(store.wal(), follower._base())  # a batch that comes again after it was folded
    assert follower._batches() == [] and state(follower) == want
    again = ship.Leader(store, f"{at}/shipped")  # a new leader process goes on
    store.put(b"x", b"1")
    assert again.shipped == 22 and again.ship() == 23
    assert again.trim(23) == 23
    leader.close()
    again.close()
    assert store.refresh().pins == {}
    with pytest.raises(StoreError):
        follower.put(b"a", b"1")
    for bad in ("boss", ""):
        with pytest.raises(ValueError):
            ship.Replication(bad, at)
    with pytest.raises(ValueError):
        ship.Replication("leader", "")


def test_maintenance_flushes_and_reaps(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", Config(mem_runs=3))
    store.create_family("f")
    store.put_until(b"k", b"v", 100)
    store.put_until(b"k", b"v", 300, "f")
    ship.maintain(store, lambda: 200, f"file://{tmp_path}/checkpoint", every="1 second", once=True).awaitTermination()
    with pytest.raises(KeyDeleted):
        store.get(b"k")
    assert store.get(b"k", family="f") == b"v"
    assert any(r.level > merge.MEM for r in store.manifest.runs)


def test_many_pins_give_the_bands_of_few(spark):
    log = spark.range(400).select(F.col("id").alias("seq")).unionByName(spark.createDataFrame([(None,)], "seq long"))
    pins = list(range(0, 390, 5))
    assert len(pins) > merge.INLINE_PINS
    want = {r.seq: sum(p < r.seq for p in pins) if r.seq is not None else 0 for r in log.collect()}
    assert {r.seq: r.b for r in log.select("seq", merge.band(pins).alias("b")).collect()} == want
    few = pins[:10]
    assert {r.seq: r.b for r in log.select("seq", merge.band(few).alias("b")).collect()} == {s: 0 if s is None else sum(p < s for p in few) for s in want}


def test_backups_name_file_systems_by_uri(spark, tmp_path):
    with pytest.raises(backup.BackupError):
        backup.open_folder("nosuchscheme://host/x")
    fs, at = backup.open_folder(f"file://{tmp_path}/a/")
    assert at == f"{tmp_path}/a" and backup.open_folder(f"{tmp_path}/a")[1] == at
    empty = Store(spark, f"file://{tmp_path}/db")
    made = empty.backup(f"file://{tmp_path}/copy", "2025-01-01T00:00:00Z")
    assert made["snap_seq"] == 0
    backup.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/again")
    assert Store(spark, f"file://{tmp_path}/again").scan().count() == 0
