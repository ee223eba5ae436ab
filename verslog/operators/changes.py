"""Rebuilding the current state of a keyed table from a change feed, newest changes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verslog.session import materialize

#: Kinds of log records.
PUT, DELETE, BEGIN, COMMIT, ABORT = 0, 1, 2, 3, 4


def effective_changes(feed: DataFrame, scope: str = "store", salts: int = 8) -> DataFrame:
    """Puts and deletes of a feed that count, with a column ``deleted``.

    A change has a non-null key and kind put, delete or null; it counts if its txn_id is 0 or null or if the feed holds a
    commit of its scope and txn_id. It deletes if its kind is delete or its tombstone true; other nulls are no deletes.
    Commits are repeated once per salt and the changes spread over the salts by key, so that a transaction which holds much
    of the feed isn't one task.
    """
    is_change = F.col("key").isNotNull() & (F.col("kind").isNull() | F.col("kind").isin(PUT, DELETE))
    changes = feed.where(is_change).withColumn("deleted", F.coalesce(F.col("kind") == DELETE, F.lit(False)) | F.coalesce(F.col("tombstone"), F.lit(False)))
    outside = F.coalesce(F.col("txn_id"), F.lit(0)) == 0
    commits = feed.where((F.col("kind") == COMMIT) & (F.col("txn_id") != 0) & F.col(scope).isNotNull()).select(F.col(scope).alias("__scope"), F.col("txn_id").alias("__txn")).distinct()
    commits = commits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    inside = changes.where(~outside).join(commits, (F.col(scope) == F.col("__scope")) & (F.col("txn_id") == F.col("__txn")) & (salt == F.col("__salt")), "left_semi")
    return changes.where(outside).unionByName(inside)


def newest_first(changes: DataFrame, keys: list[str], seq: str = "seq", deleted: str = "deleted", base: DataFrame | None = None, batches: int = 3, keep: list[str] | None = None, cuts: list[int] | None = None) -> DataFrame:
    """Current rows (keys, seq, keep...) after all changes, resolved from the newest batch of the feed back to the oldest.

    changes: any order, repeats allowed. The feed is cut into batches at ``cuts`` (the default: quantiles of ``seq``); each is
    first reduced to the newest change per key, then, from the newest batch back, keys that a later batch resolved are
    dropped (anti-join), and what remains is recorded as an image or a tombstone. Base rows whose keys no change touched come last. Of changes with equal key and seq a delete wins, then
    the largest image. Changes with a null seq are older than all others. Null keys are keys like others here (effective_changes drops them).

    Reduction before the shuffle makes a hot key one row per task and batch, and the anti-join meets each key once, so neither
    is skewed. Reduced batches and resolved keys are written to the shared folder.
    """
    keep = keep or []
    # A struct keeps nulls of the image; false sorts below true, so the delete wins a tie.
    order = F.struct(F.col(seq).alias("s"), F.col(deleted).alias("d"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(keep)])
    if keep:
        newest = [F.max(order).alias("__m")]
        parts = [F.col("__m.s").alias(seq), F.col("__m.d").alias("__deleted"), *[F.col(f"__m.v{i}").alias(c) for i, c in enumerate(keep)]]
    else:  # longs and flags stay in a hash aggregate: the newest seq, the newest of a deletion, and whether one has no seq
        newest = [F.max(seq).alias("__s"), F.max(F.when(F.col(deleted), F.col(seq))).alias("__d"), F.bool_or(F.col(deleted) & F.col(seq).isNull()).alias("__n")]
        parts = [F.col("__s").alias(seq), F.when(F.col("__s").isNull(), F.col("__n")).otherwise(F.coalesce(F.col("__d") == F.col("__s"), F.lit(False))).alias("__deleted")]
    cuts = sorted(set(cuts if cuts is not None else seq_cuts(changes, seq, batches) if batches > 1 else []))
    # Batch 0 is the oldest and has the null seqs. All batches are reduced in one pass over the feed.
    band = F.lit(0)
    for c in cuts:
        band = band + F.coalesce((F.col(seq) >= c).cast("int"), F.lit(0))
    reduced = changes.groupBy(*keys, band.alias("__band")).agg(*newest).select(*keys, "__band", *parts)
    if cuts:
        reduced = materialize(reduced, "batches", "__band")
    resolved: DataFrame | None = None

    def untouched(df: DataFrame, other: DataFrame) -> DataFrame:
        named = other.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)])
        return df.join(named, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)], "left_anti")

    for b in range(len(cuts), -1, -1):
        part = reduced.where(F.col("__band") == b).drop("__band")
        if resolved is not None:
            part = untouched(part, resolved)
            if b > 0:
                part = materialize(part, "resolved")
        resolved = part if resolved is None else resolved.unionByName(part)
    current = resolved.where("not __deleted").drop("__deleted")
    if base is not None:
        current = current.unionByName(untouched(base.select(*keys, seq, *keep), resolved))
    return current


def seq_cuts(feed: DataFrame, seq: str = "seq", batches: int = 3) -> list[int]:
    """Quantiles of seq that cut a feed into batches of about equal size; from one column of the whole feed."""
    return feed.agg(F.percentile_approx(seq, [i / batches for i in range(1, batches)], 1000)).first()[0] or []


def latest_by_window(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Newest whole row per key, for tables in which every column has to survive."""
    return changes.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(seq).desc()))).where("__r = 1").drop("__r")
