"""Log shipping: a leader that writes its store's records as a stream of files, a follower that applies them, and the sweep of
expired keys."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verslog.commits import CommitLog
from verslog.operators import ttl
from verslog.operators.changes import DELETE, PUT
from verslog.operators.resolve import newest
from verslog.sources.store import Snapshot, Store, StoreError

#: Records that a leader keeps for followers that fall behind.
RING = 65_536


def ring(log: DataFrame, capacity: int = RING, order: str = "seq") -> DataFrame:
    """The newest ``capacity`` records of a log in which ``order`` is unique. The bound is found by a top-k of one column."""
    low = log.select(order).orderBy(F.col(order).desc()).limit(capacity).agg(F.min(order)).first()[0]
    return log if low is None else log.where(F.col(order) >= low)


def ring_since(log: DataFrame, after: int, capacity: int = RING) -> DataFrame:
    """Ring records above a follower's last seq."""
    return ring(log, capacity).where(F.col("seq") > after)


def resync_needed(log: DataFrame, followers: DataFrame, capacity: int = RING) -> DataFrame:
    """(follower, last_seq, resync): whether records that a follower lacks have left the ring, so that it needs a backup."""
    low = log.select("seq").orderBy(F.col("seq").desc()).limit(capacity).agg(F.min("seq")).first()[0]
    return followers.select("follower", "last_seq", F.coalesce(F.col("last_seq") < F.lit(low) - 1, F.lit(False)).alias("resync"))


def data_records(shipped: DataFrame) -> DataFrame:
    """Puts and deletes of shipped records; transaction markers and records without key or seq change nothing. A null kind is
    a put unless its tombstone is true."""
    rows = shipped.where("key is not null and seq is not null").where(F.col("kind").isNull() | F.col("kind").isin(PUT, DELETE))
    return rows.withColumn("tombstone", F.coalesce(F.col("tombstone"), F.lit(False)) | F.coalesce(F.col("kind") == DELETE, F.lit(False)))


def lag(leader: DataFrame, follower: DataFrame, scope: str) -> DataFrame:
    """(scope, leader_seq, follower_seq, lag) per scope; a follower that has nothing is at 0."""
    a = leader.groupBy(scope).agg(F.max("seq").alias("leader_seq"))
    b = follower.groupBy(F.col(scope).alias("__s")).agg(F.max("seq").alias("follower_seq"))
    both = a.join(b, F.col(scope).eqNullSafe(F.col("__s")), "left")
    return both.select(scope, "leader_seq", F.coalesce("follower_seq", F.lit(0)).alias("follower_seq"), F.greatest(F.col("leader_seq") - F.coalesce("follower_seq", F.lit(0)), F.lit(0)).alias("lag"))


#: Columns of shipped records.
RECORD = "kind tinyint, seq long, txn_id long, family string, key binary, value binary, tombstone boolean"


class Leader:
    """Ships what a store commits. Each shipment is a folder of the records between the last one and the newest commit, under a path
    that follows from where it ends, and a commit file says that it is complete; one that failed is written anew, and records that a
    follower has got already settle by seq. A shared pin keeps compaction from dropping deletions that weren't shipped."""

    def __init__(self, store: Store, folder: str):
        self.store, self.folder = store, folder.rstrip("/")
        self._log = CommitLog(store.spark, f"{self.folder}/shipments")
        self._pin = Snapshot(store, self.shipped, shared=True)

    @property
    def shipped(self) -> int:
        """The last seq that was shipped."""
        for n in reversed(self._log.numbers()):
            if (text := self._log.read(n)) is not None:
                return json.loads(text)["upto"]
        return 0

    def ship(self) -> int:
        """Returns the last seq that is shipped now."""
        upto, after = self.store.refresh().last_seq, self.shipped
        if upto > after:
            self.store.wal(after).where(F.col("seq") <= upto).write.mode("overwrite").parquet(f"{self.folder}/records/to-{upto:020d}")
            self._log.create(upto, json.dumps({"after": after, "upto": upto}))
            old, self._pin = self._pin, Snapshot(self.store, upto, shared=True)
            old.release()
        return upto

    def stream(self) -> DataFrame:
        """The shipped records as a stream of files."""
        return self.store.spark.readStream.schema(RECORD).parquet(f"{self.folder}/records/*")

    def trim(self, before: int) -> int:
        """Removes shipments that end before a seq; followers that lack them start from a backup. Returns the first seq that is left."""
        left = 1
        for n in self._log.numbers():
            if n >= before:
                break
            self.store._fs.delete(self.store._Path(f"{self.folder}/records/to-{n:020d}"), True)
            left = n + 1
        return left

    def close(self) -> None:
        self._pin.release()


class Follower:
    """A read-only copy that applies shipped records batch by batch.

    A batch is written under the path of its number, so a batch that is repeated after a failure replaces itself; records that
    come twice or late are settled by seq when the state is read. ``compact`` folds the batches into a base, deletions included, so
    reads don't grow with history; a batch whose number the base covers is ignored when it comes again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, scope: list[str]):
        self.spark, self.folder, self.schema, self.scope = spark, folder.rstrip("/"), schema, scope
        self._log = CommitLog(spark, f"{self.folder}/bases")
        self._Path, self._fs = self._log._Path, self._log._fs

    def _base(self) -> int:
        """Number of the last batch in the base, or -1."""
        return max((n for n in self._log.numbers() if self._log.read(n) is not None), default=-1)

    def _batches(self) -> list[int]:
        at = self._Path(f"{self.folder}/records")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch="))

    def apply(self, batch: DataFrame, number: int) -> None:
        if number > self._base():
            data_records(batch).select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.folder}/records/batch={number}")

    def follow(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """Runs the stream until all that is there is applied, or with ``every`` (as '10 seconds') on and on until it is stopped."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
        if every is None:
            query.awaitTermination()
        return query

    def records(self) -> DataFrame:
        """The base and the records after it."""
        base = self._base()
        paths = [f"{self.folder}/records/batch={n}" for n in self._batches() if n > base]
        paths += [f"{self.folder}/base-{base}"] if base >= 0 else []
        return self.spark.read.schema(StructType(self.schema.fields)).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def newest(self) -> DataFrame:
        return newest(self.records(), [*self.scope, "key"])

    def state(self) -> DataFrame:
        """Live keys with value and seq."""
        return self.newest().where("not tombstone").drop("tombstone")

    def last_seq(self) -> int:
        return self.records().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def compact(self) -> None:
        """Writes what is there as a new base, makes it valid by a commit and removes what it covers."""
        upto = max(self._batches(), default=-1)
        if upto <= (old := self._base()):
            return
        self.newest().select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.folder}/base-{upto}")
        self._log.create(upto, "{}")
        for path in [f"records/batch={n}" for n in self._batches() if n <= upto] + [f"base-{old}"]:
            self._fs.delete(self._Path(f"{self.folder}/{path}"), True)

    def put(self, *_) -> None:
        raise StoreError("a follower is read-only")

    delete = batch = write = put


@dataclass(frozen=True)
class Replication:
    """Role of a node and the folder of shipments that leader and followers share."""

    role: str
    folder: str

    def __post_init__(self):
        if self.role not in ("leader", "follower"):
            raise ValueError(f"unknown role {self.role!r}")
        if not self.folder:
            raise ValueError("replication needs a folder")


def replicate(store: Store, config: Replication) -> Leader | Follower:
    """A leader ships the store. A follower is kept in the store's folder and reads the leader's shipments with ``follow_leader``."""
    if config.role == "leader":
        return Leader(store, config.folder)
    return Follower(store.spark, f"{store.folder}/follower", StructType.fromDDL("family string, key binary, value binary, seq long, tombstone boolean"), ["family"])


def follow_leader(follower: Follower, config: Replication, every: str | None = None):
    stream = follower.spark.readStream.schema(RECORD).parquet(f"{config.folder.rstrip('/')}/records/*")
    return follower.follow(stream, f"{follower.folder}/checkpoint", every)


def maintain(store: Store, clock: Callable[[], int], checkpoint: str, every: str = "1 minute", once: bool = False):
    """A stream whose every trigger flushes and compacts what is due and deletes the keys of all families that are over at
    ``clock()`` (nanoseconds). With ``once`` it ends after one trigger. Errors of other writers' races wait for the next trigger."""

    def step(_: DataFrame, __: int) -> None:
        store.refresh()
        store.flush_if_full()
        for family in ["", *store.families()]:
            store.reap(clock(), family)

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def sweep(stream: DataFrame, folder: str, checkpoint: str, now_ns: int) -> DataFrame:
    """Applies a stream of deadlines (key, expire_at_ns, seq, tombstone) and gives what a sweep at ``now_ns`` deletes."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/deadlines/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ttl.reap(spark.read.schema(stream.schema).parquet(f"{folder}/deadlines/*"), now_ns)
