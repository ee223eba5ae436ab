"""Running sums and dense numbers over a whole table in order, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verslog.session import materialize


def running_sum(df: DataFrame, order: list[Column], amount: Column, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before a row in ``order`` (exclusive). Ties are put in an order of their own.

    Rows are split into ranges of the order and written once; the sums of the ranges, one row each, are carried in, and
    within a range a window adds up.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.withColumn("__n", amount).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = cut.groupBy("__p").agg(F.sum("__n").alias("s")).select(F.col("__p").alias("__q"), F.coalesce(F.sum("s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = F.coalesce(F.sum("__n").over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + inside).drop("__p", "__q", "__b", "__n")


def number_rows(df: DataFrame, order: list[Column] | None, name: str = "n", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Adds dense numbers from ``start`` in the given order, or, with None, in whatever order the rows are in.

    Rows are written once, with their place in a range of the order; what comes before a range is added when they're read again.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df if order is None else df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The id counts up from a multiple of 2^33 in each partition, in the order of its rows.
    cut = materialize(rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33)), "numbered")
    before = cut.groupBy("__p").agg(F.count("*").alias("s")).select(F.col("__p").alias("__q"), F.coalesce(F.sum("s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return cut.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + F.col("__i") + start).drop("__p", "__q", "__b", "__i")


def zone_map(tier: DataFrame, block_bytes: int, entry: Column) -> DataFrame:
    """(page, entries, min_key, max_key): a tier in key order (newest version first) on pages of about ``block_bytes``."""
    paged = running_sum(tier, [F.col("key").asc(), F.col("seq").desc()], entry.cast("long"), "__at").withColumn("page", F.floor(F.col("__at") / block_bytes).cast("long"))
    return paged.groupBy("page").agg(F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
