"""Expiry of keys by deadlines in nanoseconds. The time is always passed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verslog.operators.resolve import live


def deadlines(ttl_log: DataFrame) -> DataFrame:
    """(key, expire_at_ns): the newest deadline of each key in a log (key, expire_at_ns, seq, tombstone). A plain write of a key
    leaves its deadline, a newer deadline replaces it, a tombstone clears it."""
    return live(ttl_log, columns=["expire_at_ns"]).where("expire_at_ns is not null").select("key", "expire_at_ns")


def remaining(ttl_log: DataFrame, now_ns: int) -> DataFrame:
    """(key, remaining_ns): negative for keys that are over and not reaped yet; keys without a deadline are not listed."""
    return deadlines(ttl_log).select("key", (F.col("expire_at_ns") - F.lit(now_ns)).alias("remaining_ns"))


def unexpired(rows: DataFrame, ttl_log: DataFrame, now_ns: int) -> DataFrame:
    """Rows whose key has no deadline at or before now."""
    over = deadlines(ttl_log).where(F.col("expire_at_ns") <= now_ns).select(F.col("key").alias("__k"))
    return rows.join(over, F.col("key") == F.col("__k"), "left_anti")


def reap(ttl_log: DataFrame, now_ns: int) -> DataFrame:
    """(key, expire_at_ns) of keys that a sweep deletes: deadlines strictly before now."""
    return deadlines(ttl_log).where(F.col("expire_at_ns") < now_ns)
