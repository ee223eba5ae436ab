"""Merging tiers, compaction, garbage collection of tombstones and the figures that trigger them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verslog.operators.order import running_sum

#: Tiers from the newest to the bottom, and bytes accounted for an entry besides key and value.
MEM, L0, L1, L2 = 0, 1, 2, 3
MEM_OVERHEAD, TIER_OVERHEAD = 32, 20
#: Sequence number above all: what is pinned when nothing is.
NOTHING_PINNED = 2**63 - 1
#: Pins up to which bands are counted within generated code; more of them are searched in batches.
INLINE_PINS = 64


def _dead() -> Column:
    return F.coalesce(F.col("tombstone"), F.lit(False))


def union_tiers(tiers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tiers)


def merge_newest(tiers: list[DataFrame]) -> DataFrame:
    """Newest version per key over tiers (key, value, seq, tombstone, level); of equal seqs the newer tier (smaller level)."""
    order = F.struct(F.col("seq").alias("seq"), (-F.col("level")).alias("n"), _dead().alias("tombstone"), F.col("value").alias("value"))
    merged = union_tiers(tiers).groupBy("key").agg(F.max(order).alias("v"))
    return merged.select("key", "v.value", "v.seq", "v.tombstone", (-F.col("v.n")).cast("tinyint").alias("level"))


def oldest_pinned(snapshots: DataFrame) -> DataFrame:
    """Smallest seq of the snapshots that aren't released; the largest long without any."""
    return snapshots.where("not released").agg(F.coalesce(F.min("seq"), F.lit(NOTHING_PINNED)).alias("oldest_pinned"))


def band(pins: list[int]) -> Column:
    """Number of pins below a version's seq (0 for a null one): versions of one key and band are seen by the same snapshots. Pins
    are objects of the driver; each sends 8 bytes to the executors and costs a step of a binary search at most."""
    cuts = np.array(sorted(set(pins)), dtype=np.int64)
    if len(cuts) <= INLINE_PINS:
        return sum((F.coalesce((F.col("seq") > F.lit(int(p))).cast("int"), F.lit(0)) for p in cuts), F.lit(0))

    @F.pandas_udf("int")
    def below(seq: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, seq.to_numpy(), side="left").astype("int32"))

    return below(F.coalesce(F.col("seq"), F.lit(-(2**63))))


def retain(log: DataFrame, pins: list[int]) -> DataFrame:
    """Versions that a pinned snapshot or the present sees: the newest of each key and band, by one hash-partitioned
    aggregation with map-side combine (no window over a key's versions)."""
    order = F.struct(F.col("seq").alias("seq"), _dead().alias("tombstone"), F.col("value").alias("value"))
    kept = log.groupBy("key", band(pins).alias("band")).agg(F.max(order).alias("v"))
    return kept.select("key", "v.value", "v.seq", "v.tombstone")


def compact(tiers: list[DataFrame], pins: list[int], bottom: bool) -> DataFrame:
    """One tier from several: what ``retain`` keeps, and at the bottom without tombstones that no snapshot can tell from absence
    (seq below the oldest pin). Above the bottom a tombstone stays, because it hides versions further down."""
    kept = retain(union_tiers(tiers), pins)
    oldest = min(pins) if pins else NOTHING_PINNED
    return kept.where(~(F.col("tombstone") & (F.col("seq") < oldest))) if bottom else kept


def entry_bytes(overhead: int) -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead


def tier_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("level").agg(F.count("*").alias("entries"), F.count_if("tombstone").alias("tombstones"), F.sum(entry_bytes(TIER_OVERHEAD)).alias("bytes"), F.max("seq").alias("max_seq"))


def flush_segments(log: DataFrame, threshold: int) -> DataFrame:
    """(seq, segment): entries in order of seq, a new segment after every ``threshold`` accounted bytes."""
    at = running_sum(log.select("seq", entry_bytes(MEM_OVERHEAD).alias("n")), [F.col("seq")], F.col("n"), "before")
    return at.select("seq", F.floor(F.col("before") / threshold).cast("long").alias("segment"))
