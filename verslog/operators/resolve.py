"""Reads of a multi-version log: rows (key, value, seq, tombstone, ...) in which the largest seq of a key is its state.

A value may be NULL or empty and is kept as it is; only ``tombstone`` marks a deletion (NULL counts as false). Versions with
equal key and seq are taken as one: a tombstone wins, then the larger value. Null keys are keys like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verslog.functions.hashing import maybe_in
from verslog.session import materialize

#: Sequence numbers of a key that one as-of group orders.
CELL = 1 << 16


def _version(columns: list[str]) -> Column:
    dead = F.coalesce(F.col("tombstone"), F.lit(False))
    return F.struct(F.col("seq").alias("seq"), dead.alias("tombstone"), *[F.col(c).alias(c) for c in columns])


def newest(log: DataFrame, keys: list[str] | None = None, at: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Newest version of each key up to a sequence number, tombstones included: (keys, seq, tombstone, columns).

    One aggregation with map-side combine, so a key that holds a third of the log is one row per task after the scan; the
    bound on seq is applied before and reaches the Parquet scan.
    """
    keys, columns = keys or ["key"], ["value"] if columns is None else columns
    rows = log if at is None else log.where(F.col("seq") <= at)
    return rows.groupBy(*keys).agg(F.max(_version(columns)).alias("v")).select(*keys, "v.seq", "v.tombstone", *[f"v.{c}" for c in columns])


def live(log: DataFrame, keys: list[str] | None = None, at: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """As newest, without deleted keys."""
    return newest(log, keys, at, columns).where("not tombstone").drop("tombstone")


def get_status(log: DataFrame, wanted: DataFrame, at: int | None = None, deadlines: DataFrame | None = None, now_ns: int | None = None) -> DataFrame:
    """(key, status, value, seq) for each row of ``wanted`` (key): FOUND, DELETED, NOT_FOUND or, with deadlines (key,
    expire_at_ns), EXPIRED when now_ns has reached the key's deadline. The log is cut to the wanted keys first."""
    asked = wanted.select("key").distinct()
    found = newest(log.join(asked.select(F.col("key").alias("__k")), F.col("key").eqNullSafe(F.col("__k")), "left_semi"), at=at)
    rows = wanted.select(F.col("key").alias("k")).join(found, F.col("k").eqNullSafe(F.col("key")), "left")
    status = F.when(F.col("seq").isNull(), "NOT_FOUND").when(F.col("tombstone"), "DELETED").otherwise("FOUND")
    if deadlines is not None:
        rows = rows.join(deadlines.select(F.col("key").alias("d"), "expire_at_ns"), F.col("k").eqNullSafe(F.col("d")), "left")
        status = F.when(F.col("expire_at_ns") <= F.lit(now_ns), "EXPIRED").otherwise(status)
    return rows.withColumn("status", status).select(F.col("k").alias("key"), "status", F.when(F.col("status") == "FOUND", F.col("value")).alias("value"), F.when(F.col("status").isin("FOUND", "DELETED"), F.col("seq")).alias("seq"))


def seq_at(log: DataFrame, wanted: DataFrame, at: int) -> DataFrame:
    """(key, seq): the version that is visible at a sequence number, tombstones included, or 0."""
    have = log.where(F.col("seq") <= at).groupBy("key").agg(F.max("seq").alias("seq"))
    return wanted.select(F.col("key").alias("k")).join(have, F.col("k") == F.col("key"), "left").select(F.col("k").alias("key"), F.coalesce("seq", F.lit(0)).alias("seq"))


def asof(log: DataFrame, probes: DataFrame, columns: list[str] | None = None, cell: int = CELL) -> DataFrame:
    """All probes (key, at, ...) with the newest version of their key up to ``at``: found_seq, found_tombstone and
    found_<column>, NULL where there is none. Null keys or bounds find nothing.

    Keys are cut into cells of sequence numbers. The newest version of each cell is carried over to the next ones, and
    within a cell one window passes versions on to probes, so neither versions nor probes of a hot key meet in one task and
    no pairs are made. Windows carry seq and tombstone alone; values are fetched afterwards, for the versions that were found.
    """
    columns = ["value"] if columns is None else columns
    if columns:
        found = materialize(asof(log, probes, [], cell), "asof")  # read twice below
        one = found.where("found_seq is not null").select(F.col("key").alias("__k"), F.col("found_seq").alias("__s")).distinct()
        rows = maybe_in(log.select("key", "seq", "tombstone", *columns), F.xxhash64("key", "seq"), one, F.xxhash64("__k", "__s"))
        rows = rows.groupBy("key", "seq").agg(F.max(_version(columns)).alias("__v")).select(F.col("key").alias("__k"), F.col("seq").alias("__s"), *[F.col(f"__v.{c}").alias(f"found_{c}") for c in columns])
        return found.join(rows, (F.col("key") == F.col("__k")) & (F.col("found_seq") == F.col("__s")), "left").drop("__k", "__s")
    extra = [c for c in probes.columns if c not in ("key", "at")]
    versions = log.where("key is not null and seq is not null").select("key", (F.floor(F.col("seq") / cell)).alias("cell"), F.col("seq").alias("pos"), _version(columns).alias("v"))
    kind = versions.schema["v"].dataType
    none = F.lit(None).cast(kind)
    asks = probes.select("key", F.floor(F.col("at") / cell).alias("cell"), F.col("at").alias("pos"), none.alias("v"), F.struct(F.lit(1).alias("__ask"), *[F.col(c) for c in extra]).alias("p"))
    empty = F.lit(None).cast(asks.schema["p"].dataType)
    last = versions.groupBy("key", "cell").agg(F.max("v").alias("v"))
    cells = last.unionByName(asks.where("key is not null and pos is not null").select("key", "cell", none.alias("v")).distinct()).groupBy("key", "cell").agg(F.max("v").alias("v"))
    before = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    carried = cells.select("key", "cell", F.last("v", ignorenulls=True).over(before).alias("v")).where("v is not null")
    rows = (
        versions.select("key", "cell", "pos", "v", empty.alias("p"), F.lit(1).alias("o"))
        .unionByName(carried.select("key", "cell", (F.col("cell") * cell).cast("long").alias("pos"), "v", empty.alias("p"), F.lit(0).alias("o")))
        .unionByName(asks.select("key", "cell", F.col("pos").cast("long").alias("pos"), "v", "p", F.lit(2).alias("o")))
    )
    order = W.partitionBy("key", "cell").orderBy("pos", "o", "v.seq", "v.tombstone").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.withColumn("f", F.when(F.col("key").isNotNull() & F.col("pos").isNotNull(), F.last("v", ignorenulls=True).over(order))).where("o = 2")
    return seen.select("key", F.col("pos").alias("at"), *[F.col(f"p.{c}").alias(c) for c in extra], F.col("f.seq").alias("found_seq"), F.col("f.tombstone").alias("found_tombstone"), *[F.col(f"f.{c}").alias(f"found_{c}") for c in columns])


def history(log: DataFrame, cell: int = CELL) -> DataFrame:
    """Each version with the seq before and after it under its key (a cursor's previous and next). Windows go over cells of
    sequence numbers, and the ends of neighbouring cells are carried in, so a hot key is many tasks."""
    rows = log.select("key", "seq", F.floor(F.col("seq") / cell).alias("cell"))
    order = W.partitionBy("key").orderBy("cell")
    ends = rows.groupBy("key", "cell").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    ends = ends.select(F.col("key").alias("k"), F.col("cell").alias("c"), F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    w = W.partitionBy("key", "cell").orderBy("seq")
    inside = rows.select("key", "cell", "seq", F.lag("seq").over(w).alias("p"), F.lead("seq").over(w).alias("n"))
    return inside.join(ends, F.col("key").eqNullSafe(F.col("k")) & F.col("cell").eqNullSafe(F.col("c"))).select("key", "seq", F.coalesce("p", "before").alias("prev_seq"), F.coalesce("n", "after").alias("next_seq"))
