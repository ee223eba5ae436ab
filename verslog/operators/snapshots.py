"""What changed between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verslog.functions.hashing import maybe_in, row_hash
from verslog.session import materialize

#: Rows of both sides that one bucket is sized for: 17 bytes a row in numpy.
BUCKET_ROWS = 1 << 20

#: Codes of a change.
CHANGES = ("added", "removed", "changed")


def _unique(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once with its largest row hash."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    last = np.append(keys[1:] != keys[:-1], True) if len(keys) else np.zeros(0, dtype=bool)
    return keys[last], rows[last]


def compare_bucket(table: pa.Table) -> pa.Table:
    """(pair, key, row, new) of one bucket to (pair, key, change): sorted arrays and searchsorted set differences."""
    pairs = pc.unique(table.column("pair"))
    code = pc.index_in(table.column("pair"), pairs).to_numpy().astype(np.uint64)
    key, row, new = (table.column(n).to_numpy() for n in ("key", "row", "new"))
    # One number for pair and key; the key's hash is spread by the pair's place in the bucket.
    both_ids = key.view(np.uint64) + code * np.uint64(0x9E3779B97F4A7C15)
    old_k, old_r = _unique(both_ids[~new], row[~new])
    new_k, new_r = _unique(both_ids[new], row[new])
    at = np.minimum(np.searchsorted(old_k, new_k), max(0, len(old_k) - 1))
    both = old_k[at] == new_k if len(old_k) else np.zeros(len(new_k), dtype=bool)
    back = np.minimum(np.searchsorted(new_k, old_k), max(0, len(new_k) - 1))
    kept = new_k[back] == old_k if len(new_k) else np.zeros(len(old_k), dtype=bool)
    differs = both.copy()
    differs[both] = old_r[at[both]] != new_r[both]
    found = np.concatenate([new_k[~both], old_k[~kept], new_k[differs]])
    change = np.repeat(np.arange(3, dtype=np.int8), [int((~both).sum()), int((~kept).sum()), int(differs.sum())])
    order = np.argsort(both_ids, kind="stable")
    first = order[np.searchsorted(both_ids, found, sorter=order)]
    return pa.table({"pair": table.column("pair").take(pa.array(first)), "key": key[first], "change": change})


def snapshot_changes(snapshots: DataFrame, items: str, key: Callable[[Column], Column], row: Callable[[Column], Column], buckets: int | None = None) -> DataFrame:
    """Rows (snapshot, key, change) with change added, removed or changed, for each snapshot but the first of its scope.

    snapshots: (scope, snapshot, taken_at, <items> array); a row listed several times, with the same or another order of
    items, is one snapshot. Rows with a null scope, snapshot, taken_at or array are no snapshots; an empty array is a
    snapshot without items. Snapshots of a scope follow each other by (taken_at, snapshot). ``key`` and ``row`` give key
    and content of an item; of an item listed repeatedly under one key the one with the largest row hash counts. A null key
    is a key like others, and a null row differs from every value.

    Items become hashes where they are read, and only the hashes are shuffled: 8 bytes each for key and row, and the pair. They
    are spread by the hash of pair and key, so neither a scope nor a snapshot that holds a third of all items makes a
    large bucket. Full keys are read again for the differing ones alone: the others are filtered out before the shuffle. Two keys
    of a snapshot with equal 64-bit hashes would be taken for one, which one pair in 10^19 is.
    """
    named = snapshots.select("scope", "snapshot", "taken_at", F.col(items).alias("items")).dropna()
    # One light row per snapshot: ids and times only.
    runs = named.groupBy("snapshot").agg(F.min("scope").alias("scope"), F.min("taken_at").alias("taken_at"))
    order = W.partitionBy("scope").orderBy("taken_at", "snapshot")
    runs = runs.select("snapshot", F.lag("snapshot").over(order).alias("old"), F.lead("snapshot").over(order).alias("next"))
    sides = F.array_compact(
        F.array(F.when(F.col("old").isNotNull(), F.struct(F.col("snapshot").alias("pair"), F.lit(True).alias("new"))), F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("pair"), F.lit(False).alias("new"))))
    )
    hashed = named.select("snapshot", F.transform("items", lambda i: F.struct(row_hash(key(i)).alias("key"), row_hash(row(i)).alias("row"))).alias("items"))
    paired = hashed.join(runs, "snapshot").select("items", F.explode(sides).alias("side"))
    small = paired.select(F.col("side.pair").alias("pair"), F.col("side.new").alias("new"), F.inline("items"))
    if buckets is None:
        total = snapshots.agg(F.coalesce(F.sum(F.size(items)), F.lit(0))).first()[0]
        buckets = max(1, -(-2 * total // BUCKET_ROWS), snapshots.sparkSession.sparkContext.defaultParallelism)
    kind = dict(small.dtypes)["pair"]
    small = small.withColumn("bucket", F.pmod(F.xxhash64("pair", "key"), F.lit(buckets)))
    found = small.groupBy("bucket").applyInArrow(compare_bucket, f"pair {kind}, key long, change tinyint")
    # A removed item is named by the older snapshot of the pair, others by the newer one.
    links = runs.select(F.col("snapshot").alias("s"), "old")
    found = found.join(links, F.col("pair") == F.col("s")).select("pair", "key", "change", F.when(F.col("change") == 1, F.col("old")).otherwise(F.col("pair")).alias("source"))
    found = materialize(found, "differing")  # read twice below
    names = named.select(F.col("snapshot").alias("n"), F.explode("items").alias("item")).select("n", key(F.col("item")).alias("full_key")).withColumn("k", row_hash(F.col("full_key")))
    names = maybe_in(names, F.xxhash64("n", "k"), found, F.xxhash64("source", "key"))
    hit = found.join(names, (F.col("source") == F.col("n")) & (F.col("key") == F.col("k")))
    label = F.element_at(F.array(*map(F.lit, CHANGES)), F.col("change").cast("int") + 1)
    return hit.select("pair", "full_key", "change").distinct().select(F.col("pair").alias("snapshot"), F.col("full_key").alias("key"), label.alias("change"))
