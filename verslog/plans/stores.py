"""Queries that run the store itself, in a folder of their own, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verslog.operators import ttl
from verslog.plans.kv import _LOG, _TTL, NOW_NS, _newest
from verslog.session import scratch
from verslog.sources import backup
from verslog.sources import log as L
from verslog.sources.store import Config, KeyDeleted, KeyNotFound, Store, TxnConflict
from verslog.streaming import ship


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "seq")


def _filled(spark: SparkSession, sf: str, parts: int = 2, flush: bool = True) -> tuple[Store, int]:
    """A store with the log of events, written in order in several commits, with a flush after each."""
    log = L.event_log(spark, sf)
    last = L.last_seq(log)
    store = Store(spark, scratch(spark, "store"), Config(l0_runs=3))
    for i in range(parts):
        part = log.where((F.col("seq") > last * i // parts) & (F.col("seq") <= last * (i + 1) // parts))
        store.write(part.select("key", "value", "tombstone", "seq"), ["seq"])
        if flush:
            store.flush()
    return store, last


def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """What the store gives back after several commits and flushes, read by another process."""
    store, _ = _filled(spark, sf)
    return _text(Store(spark, store.folder, read_only=True).scan())


def store_compacted_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What a snapshot of the middle of the log still sees after everything was compacted into the bottom tier and cleaned up."""
    store, last = _filled(spark, sf, flush=False)
    pin = ship.Snapshot(store, last // 2)
    store.flush()
    store.compact(to_bottom=True)
    store.vacuum()
    return _text(store.scan(snapshot=pin.seq))


def store_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after deadlines were written and a sweep deleted what is over."""
    store, _ = _filled(spark, sf, parts=1)
    store.write_deadlines(ttl.deadlines(L.ttl_log(L.event_log(spark, sf))))
    store.reap(NOW_NS)
    return _text(store.scan())


def txn_commit_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions that read one of the first live keys each; every other one meets a write of its key and a flush before it commits."""
    store, _ = _filled(spark, sf, parts=1)
    other, out = Store(spark, store.folder, Config(l0_runs=100)), []
    for i, row in enumerate(store.scan(limit=4).collect()):
        t = store.begin()
        t.get(bytes(row.key))
        if i % 2:
            other.put(bytes(row.key), b"theirs")
            other.flush()
        t.put(bytes(row.key), b"mine")
        try:
            t.commit()
            outcome = "COMMITTED"
        except TxnConflict:
            outcome = "CONFLICT"
        try:
            value = store.get(bytes(row.key)).decode()
        except (KeyDeleted, KeyNotFound):
            value = None
        out.append((bytes(row.key).decode(), outcome, value))
    return spark.createDataFrame(out, "key string, outcome string, value string")


def backup_restore_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All orders after a backup and a restore into another folder."""
    at = scratch(spark, "store")
    store = Store(spark, f"{at}/db")
    orders = L.table(spark, sf, "orders")
    store.write(orders.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"), "o_orderkey"), ["o_orderkey"])
    store.backup(f"{at}/backup", "2025-01-01T00:00:00Z")
    backup.restore(spark, f"{at}/backup", f"{at}/again")
    return _text(Store(spark, f"{at}/again", read_only=True).scan())


def leader_follower(spark: SparkSession, sf: str) -> DataFrame:
    """State of a follower that got a leader's log in two shipments, with flushes and a compaction on both sides in between."""
    at = scratch(spark, "replica")
    log = L.event_log(spark, sf)
    last = L.last_seq(log)
    store = Store(spark, f"{at}/leader")
    config = ship.Replication("follower", f"{at}/shipped")
    leader, follower = ship.replicate(store, ship.Replication("leader", f"{at}/shipped")), ship.replicate(Store(spark, f"{at}/copy"), config)
    for low, high in ((0, last // 2), (last // 2, last)):
        store.write(log.where((F.col("seq") > low) & (F.col("seq") <= high)).select("key", "value", "tombstone", "seq"), ["seq"])
        if low:
            store.flush()
            store.compact(to_bottom=True)
        if leader.ship():
            ship.follow_leader(follower, config)
        follower.compact()
    leader.close()
    return _text(follower.state())


QUERIES = {f.__name__: f for f in (store_roundtrip, store_compacted_scan, store_expiry, txn_commit_outcomes, backup_restore_rows, leader_follower)}

_LIVE = _LOG + _newest("log", "c")

ORACLE = {
    "store_roundtrip": _LIVE + "SELECT key, value, seq FROM c WHERE NOT tombstone",
    "store_compacted_scan": _LOG + ", h AS (SELECT log.* FROM log, n WHERE seq <= n // 2)" + _newest("h", "c") + "SELECT key, value, seq FROM c WHERE NOT tombstone",
    "store_expiry": _LIVE + _TTL + f"SELECT key, value, seq FROM c WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM td WHERE td.key = c.key AND td.expire_at_ns < {NOW_NS})",
    "txn_commit_outcomes": _LIVE
    + """, f AS (SELECT key, row_number() OVER (ORDER BY key) AS r FROM c WHERE NOT tombstone)
SELECT key, CASE WHEN r % 2 = 1 THEN 'COMMITTED' ELSE 'CONFLICT' END AS outcome, CASE WHEN r % 2 = 1 THEN 'mine' ELSE 'theirs' END AS value FROM f WHERE r <= 4""",
    "backup_restore_rows": "SELECT CAST(o_orderkey AS varchar) AS key, o_orderpriority AS value, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders",
    "leader_follower": _LIVE + "SELECT key, value, seq FROM c WHERE NOT tombstone",
}
