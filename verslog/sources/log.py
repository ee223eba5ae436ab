"""The canonical log over the test tables, and tables seen as namespaces of one log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verslog.operators.merge import L0, L1, L2, MEM


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files. As a pattern the path may be a single file or a folder."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name[:-1]}?.parquet")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Versions per user and slot: seq, key, value, tombstone (errors delete), ts and txn_id (four of ten in transactions)."""
    dead = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), (F.col("event_id") % 8).cast("string")).alias("key"),
        F.when(~dead, F.concat("event_type", F.lit("|"), "props")).alias("value"),
        dead.alias("tombstone"),
        "ts",
        F.when(F.col("event_id") % 10 < 4, F.floor(F.col("event_id") / 10).cast("long") + 1).otherwise(F.lit(0)).alias("txn_id"),
        "event_type",
        "props",
    )


def last_seq(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def tier_of(seq: Column, last: int) -> Column:
    """Tiers by age: the oldest 40 % of the log at the bottom, then 30 %, 20 %, and the newest 10 % in memory."""
    return F.when(seq * 10 <= last * 4, L2).when(seq * 10 <= last * 7, L1).when(seq * 10 <= last * 9, L0).otherwise(MEM).cast("tinyint")


def split_tiers(log: DataFrame, last: int) -> list[DataFrame]:
    """One table per tier, newest tier first; each reads its own part of the log."""
    rows = log.withColumn("level", tier_of(F.col("seq"), last))
    return [rows.where(F.col("level") == n) for n in (MEM, L0, L1, L2)]


def ttl_log(log: DataFrame) -> DataFrame:
    """Deadlines: a sign-up expires six hours after it happened; deletions clear the deadline."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 6 * 3600 * 10**9
    return log.where(F.col("event_type").isin("signup", "error")).select("key", F.when(~F.col("tombstone"), ns).alias("expire_at_ns"), "seq", "tombstone")


def entry_log(spark: SparkSession, sf: str) -> DataFrame:
    """Stored versions with binary keys."""
    return table(spark, sf, "entries")


def family_log(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, orders and parts as families of one log, and events by their type."""
    one = lambda t, name, key, value: table(spark, sf, t).select(F.lit(name).alias("family"), F.col(key).cast("string").alias("key"), F.col(value).alias("value"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("tombstone"))
    events = event_log(spark, sf).select(F.col("event_type").alias("family"), "key", "value", "seq", "tombstone")
    return one("customer", "customer", "c_custkey", "c_name").unionByName(one("orders", "orders", "o_orderkey", "o_orderpriority")).unionByName(one("part", "part", "p_partkey", "p_name")).unionByName(events)
