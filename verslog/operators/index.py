"""Secondary indexes: entries (index_key, pk) that a key function derives from each record.

A key function is a Python callable from the pk and value columns to an array column, so it runs within the plan; a vectorised
UDF that returns an array does as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verslog.operators.resolve import live

KeyFn = Callable[[Column, Column], Column]


def build(log: DataFrame, fn: KeyFn) -> DataFrame:
    """Distinct entries of all live records; null index keys give none."""
    rows = live(log).select(F.col("key").alias("pk"), F.explode(F.array_distinct(fn(F.col("key"), F.col("value")))).alias("index_key"))
    return rows.where("index_key is not null").select("index_key", "pk")


def point(index: DataFrame, key: str | bytes) -> DataFrame:
    return index.where(F.col("index_key") == F.lit(key)).select("pk").orderBy("pk")


def between(index: DataFrame, low: str | bytes, high: str | bytes | None) -> DataFrame:
    """Entries with index_key in [low, high), ordered by (index_key, pk); a record with several keys appears for each."""
    rows = index.where(F.col("index_key") >= F.lit(low))
    return (rows if high is None else rows.where(F.col("index_key") < F.lit(high))).orderBy("index_key", "pk")


def changes(before: DataFrame, after: DataFrame, fn: KeyFn) -> DataFrame:
    """(pk, index_key, change) that a write of records makes: ADD and REMOVE of entries, from rows (key, value, tombstone)
    before and after. Entries on both sides stay."""

    def entries(df: DataFrame, n: int) -> DataFrame:
        keys = F.explode(F.array_distinct(fn(F.col("key"), F.col("value")))).alias("index_key")
        return df.where("not tombstone").select(F.col("key").alias("pk"), keys).where("index_key is not null").distinct().withColumn("n", F.lit(n))

    both = entries(before, -1).unionByName(entries(after, 1)).groupBy("pk", "index_key").agg(F.sum("n").alias("n"))
    return both.where("n <> 0").select("pk", "index_key", F.when(F.col("n") > 0, "ADD").otherwise("REMOVE").alias("change"))


def fetch(index: DataFrame, log: DataFrame) -> DataFrame:
    """Entries with the current value of their record."""
    return index.join(live(log).select(F.col("key").alias("pk"), "value"), "pk").select("index_key", "pk", "value")


def consistency(index: DataFrame, log: DataFrame, fn: KeyFn) -> DataFrame:
    """(index_key, pk, state): STALE entries that the current records don't give, MISSING ones that they do."""
    n = index.select("index_key", "pk", F.lit(1).alias("n")).unionByName(build(log, fn).select("index_key", "pk", F.lit(-1).alias("n"))).groupBy("index_key", "pk").agg(F.sum(F.signum("n")).alias("n"))
    return n.where("n <> 0").select("index_key", "pk", F.when(F.col("n") > 0, "STALE").otherwise("MISSING").alias("state"))
