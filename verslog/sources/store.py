"""A store of versioned keys in a folder: Parquet runs in tiers, and a manifest per commit.

A commit writes its run first and then creates the next manifest exclusively; of two writers that start from the same
manifest one fails, reads the newer one and tries again, a transaction after it was validated anew. Runs are never changed. Rows of
a run are numbered from 1, and the manifest says at which sequence number the run begins, so a commit that has to be tried again
needn't rewrite its rows. A run is removed only after a manifest named it doomed, and a commit of a doomed or missing run fails, so
cleaning up and writing may go on at the same time.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verslog.commits import CommitLog, LostRace
from verslog.operators import bloom, changes, index, merge, resolve, scan, ttl, txn
from verslog.operators.families import check_name
from verslog.operators.index import KeyFn
from verslog.operators.order import number_rows
from verslog.session import temporary
from verslog.sources import backup

_ROW = "family string, key binary, value binary, tombstone boolean, expire_at_ns long, kind string, txn_id long, n long"
#: Kinds of rows besides data: deadlines, index entries (value: index key; family: name of the index), and the begin and commit
#: of a transaction.
DATA, TTL, ENTRY, BEGIN, COMMIT = "d", "t", "x", "b", "c"


class StoreError(Exception):
    pass


class KeyNotFound(StoreError):
    pass


class KeyDeleted(StoreError):
    pass


class Closed(StoreError):
    pass


class TxnClosed(StoreError):
    pass


class TxnConflict(StoreError):
    pass


class TxnTooLarge(StoreError):
    pass


class RunLost(StoreError):
    """The run of a commit was cleaned up before the commit; the write has to be done again."""


class Raced(StoreError):
    """Other runs than those that were folded are there now."""


@dataclass(frozen=True)
class Config:
    """Thresholds and codecs; memory is the tier of small, just written runs. A write that brings it to ``mem_bytes`` or ``mem_runs``
    flushes it. With ``filters`` a folded run has an exact filter for each of its files: reads of one key open only files that may hold
    it, and count what the filters said, by which the rate of the next ones is set. ``grace_s`` is the age from which a run without a commit is taken for that of a dead writer, ``patience_s`` the time
    for which a commit is tried. With ``lazy_expiry`` a read that meets an expired key deletes it."""

    mem_bytes: int = 64 << 20
    mem_runs: int = 64
    l0_runs: int = 4
    l1_bytes: int = 256 << 20
    codecs: tuple[str, str, str, str] = ("snappy", "snappy", "snappy", "zstd")
    bloom_rate: float = bloom.FPR_TARGET
    target_file_bytes: int = 256 << 20
    grace_s: float = 24 * 3600.0
    patience_s: float = 300.0
    lazy_expiry: bool = False
    filters: bool = False


@dataclass
class Run:
    path: str
    level: int
    base: int
    rows: int
    bytes: int
    latest_only: bool = False
    max_seq: int = 0
    #: Bits and hash functions of the filters of its files, if it has such.
    filter: tuple[int, int] | None = None


@dataclass
class Manifest:
    version: int = 0
    last_seq: int = 0
    last_txn: int = 0
    families: list[str] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)
    #: Folded runs that are still there, runs that are being removed, and shared pins by their id.
    retired: list[str] = field(default_factory=list)
    doomed: list[str] = field(default_factory=list)
    pins: dict[str, int] = field(default_factory=dict)
    #: Deletions up to this seq may be gone from the bottom tier.
    collected: int = 0

    def copy(self) -> Manifest:
        return Manifest(**{k: v.copy() if isinstance(v, list | dict) else v for k, v in vars(self).items()})


class Snapshot:
    """A pinned sequence number; compaction keeps what it sees until it is released as often as it was taken. Pins are known to the
    process that took them, shared ones to all processes: they are in the manifest, and taking and releasing them are commits."""

    def __init__(self, store: Store, seq: int, shared: bool = False):
        self.store, self.seq, self.refs, self.id = store, seq, 1, uuid.uuid4().hex if shared else None
        if shared:
            store._commit(lambda m: m.pins.update({self.id: seq}))
        else:
            store._pins.append(self)

    def retain(self) -> Snapshot:
        self.refs += 1
        return self

    def release(self) -> None:
        self.refs -= 1
        if self.refs == 0 and self.id is not None:
            self.store._commit(lambda m: m.pins.pop(self.id, None))
        elif self.refs == 0:
            self.store._pins.remove(self)


class Store:
    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, read_only: bool = False):
        self.spark, self.folder, self.config, self.read_only = spark, folder.rstrip("/"), config or Config(), read_only
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._log = CommitLog(spark, self.folder + "/manifests")
        self._schema = StructType.fromDDL(_ROW)
        self._pins: list[Snapshot] = []
        self._indexes: dict[str, KeyFn] = {}
        self._closed = False
        self.telemetry = bloom.Telemetry()
        self.manifest = self._newest_manifest()

    # --- manifests and runs ------------------------------------------------------------------------------------------

    def _newest_manifest(self) -> Manifest:
        for n in reversed(self._log.numbers()):
            if (text := self._log.read(n)) is not None:
                raw = json.loads(text)
                return Manifest(**(raw | {"runs": [Run(**r) for r in raw["runs"]]}))
        return Manifest()

    def refresh(self) -> Manifest:
        """The newest manifest: the ones after the known one are read on, as their numbers have no gaps."""
        while (text := self._log.read(self.manifest.version + 1)) is not None:
            raw = json.loads(text)
            self.manifest = Manifest(**(raw | {"runs": [Run(**r) for r in raw["runs"]]}))
        return self.manifest

    def _commit(self, change) -> Manifest:
        """change(copy of the newest manifest) makes it the next one."""
        self._writable()
        until, pause = time.monotonic() + self.config.patience_s, 0.01
        while True:
            nxt = self.refresh().copy()
            change(nxt)
            nxt.version += 1
            try:
                self._log.create(nxt.version, json.dumps(asdict(nxt)))
            except LostRace:
                if time.monotonic() > until:
                    raise StoreError("other writers commit all the time") from None
                time.sleep(pause * random.random())
                pause = min(2 * pause, 1.0)
                continue
            self.manifest = nxt
            return nxt

    def _present(self, m: Manifest, run: Run) -> None:
        """A commit may name a run only if no manifest doomed it and its folder is there; a later removal sees the commit."""
        if run.path in m.doomed or not self._fs.exists(self._Path(f"{self.folder}/{run.path}")):
            raise RunLost(run.path)

    def _writable(self) -> None:
        if self._closed:
            raise Closed("the store is closed")
        if self.read_only:
            raise StoreError("the store is read-only")

    def _write_run(self, rows: DataFrame, level: int) -> Run:
        path = f"runs/{uuid.uuid4().hex}"
        seen = Observation()
        size = F.coalesce(F.sum(merge.entry_bytes(merge.MEM_OVERHEAD)), F.lit(0)).alias("bytes")
        writer = rows.observe(seen, size, F.coalesce(F.max("n"), F.lit(0)).alias("last")).write.option("compression", self.config.codecs[level])
        if level > merge.MEM:  # readers skip row groups whose filter lacks the key
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.telemetry.rate(self.config.bloom_rate)))
        writer.parquet(f"{self.folder}/{path}")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{path}").count()  # from the footers
        run = Run(path, level, 0, n, seen.get["bytes"], max_seq=seen.get["last"])
        if level > merge.MEM and n and self.config.filters:
            run.filter = self._write_filters(path)
        return run

    def _write_filters(self, path: str) -> tuple[int, int]:
        """Filters of the files of a run, sized for the largest file, in a folder that readers of the run pass over."""
        keys = self.spark.read.schema(self._schema).parquet(f"{self.folder}/{path}").where(F.col("kind") == DATA).select(F.col("_metadata.file_name").alias("file"), "key")
        most = keys.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
        m, k = bloom.size(most, self.telemetry.rate(self.config.bloom_rate))
        words = bloom.build(keys, "file", "key", m, k)
        words.repartitionByRange(max(1, self.spark.sparkContext.defaultParallelism // 4), "word").sortWithinPartitions("word").write.parquet(f"{self.folder}/{path}/_filters")
        return m, k

    def _holding(self, run: Run, key: bytes) -> DataFrame | None:
        """Rows of a run with filters that have a key, from the files that may hold it; what the filters said is counted."""
        words = self.spark.read.schema("file string, word long, bits long").parquet(f"{self.folder}/{run.path}/_filters")
        files = [r.file for r in bloom.maybe_files(words, key, *run.filter).collect()]
        if not files:
            return None
        rows = self.spark.read.schema(self._schema).parquet(*[f"{self.folder}/{run.path}/{f}" for f in files]).where(F.col("key") == F.lit(key))
        held = {r.file for r in rows.select(F.col("_metadata.file_name").alias("file")).distinct().collect()}
        self.telemetry.record(run.path, len(files), len(set(files) - held))
        return rows if held else None

    def _rows_of(self, runs: list[Run]) -> DataFrame:
        out = self.spark.createDataFrame([], self._schema).withColumns({"seq": F.lit(0).cast("long"), "level": F.lit(0)})
        for r in runs:
            part = self.spark.read.schema(self._schema).parquet(f"{self.folder}/{r.path}")
            out = out.unionByName(part.withColumns({"seq": F.col("n") + F.lit(r.base), "level": F.lit(r.level)}))
        return out

    def _read(self, runs: list[Run] | None = None, kind: str = DATA) -> DataFrame:
        """All rows of some runs with their seq and level. The kind is a column that Parquet statistics prune by."""
        return self._rows_of(self.manifest.runs if runs is None else runs).where(F.col("kind") == kind).drop("kind", "n")

    def wal(self, after: int = 0) -> DataFrame:
        """Log records (kind, seq, txn_id, family, key, value, tombstone) above a seq: puts and deletes, and the begin and commit of
        transactions as far as they aren't folded yet. Runs that end before are not read."""
        rows = self._rows_of([r for r in self.manifest.runs if r.max_seq > after]).where((F.col("seq") > after) & F.col("kind").isin(DATA, BEGIN, COMMIT))
        kind = F.when(F.col("kind") == BEGIN, changes.BEGIN).when(F.col("kind") == COMMIT, changes.COMMIT).when(F.col("tombstone"), changes.DELETE).otherwise(changes.PUT)
        return rows.select(kind.cast("tinyint").alias("kind"), "seq", "txn_id", "family", "key", "value", "tombstone")

    def log(self, family: str | None = "") -> DataFrame:
        """All versions of a family, or of all with None: (family, key, value, seq, tombstone, txn_id, level)."""
        rows = self._read()
        return rows if family is None else rows.where(F.col("family") == family)

    # --- writes ------------------------------------------------------------------------------------------------------

    def write(self, ops: DataFrame, order: list[str] | None = None, family: str = "", txn_id: int = 0) -> int:
        """One commit of many operations (key, value, tombstone), a sequence number each, in the given order (the default
        takes any order, which is enough if keys are distinct). A later operation on the same key wins. Returns the last seq."""
        marks = {f"__o{i}": F.col(c) for i, c in enumerate(order or [])}
        with temporary(self.spark):
            rows = number_rows(self._rows(ops.withColumns(marks), family, DATA), [F.col(c) for c in marks] or None, "n")
            return self._append(rows.withColumn("txn_id", F.lit(txn_id).cast("long")))

    def _rows(self, ops: DataFrame, family: str, kind: str) -> DataFrame:
        have = dict(ops.dtypes)
        binary = lambda c: F.col(c).cast("binary") if c in have else F.lit(None).cast("binary")
        return ops.withColumns(
            {
                "family": F.col("family") if "family" in have else F.lit(family), "key": binary("key"), "value": binary("value"), "kind": F.lit(kind), "txn_id": F.lit(0).cast("long"),
                "tombstone": F.coalesce(F.col("tombstone"), F.lit(False)) if "tombstone" in have else F.lit(False), "expire_at_ns": F.col("expire_at_ns").cast("long") if "expire_at_ns" in have else F.lit(None).cast("long"),
            }
        )

    def _append(self, rows: DataFrame, check=None, families=None) -> int:
        self._writable()
        run = self._write_run(rows.select(*self._schema.fieldNames()), merge.MEM)
        if run.rows == 0 and families is None:
            return self.manifest.last_seq

        def change(m: Manifest) -> None:
            self._present(m, run)
            if check:
                check(m)
            m.runs.append(Run(run.path, run.level, m.last_seq, run.rows, run.bytes, max_seq=m.last_seq + run.max_seq))
            m.last_seq += run.max_seq
            m.last_txn += 1
            if families:
                m.families = families(m.families)

        last = self._commit(change).last_seq
        self.flush_if_full()
        return last

    def _small(self, rows: list[tuple], kind: str = DATA) -> DataFrame:
        """A few rows (family, key, value, tombstone, expire_at_ns, kind) in order."""
        made = [(f, k, v, t, x, kd or kind, 0, i + 1) for i, (f, k, v, t, x, kd) in enumerate(rows)]
        return self.spark.createDataFrame(made, self._schema).coalesce(1)

    def put(self, key: bytes, value: bytes, family: str = "") -> int:
        return self._append(self._small([(family, key, value, False, None, None)]))

    def delete(self, key: bytes, family: str = "") -> int:
        return self._append(self._small([(family, key, None, True, None, None)]))

    def batch(self, ops: list[tuple[bytes, bytes | None]], family: str = "") -> int:
        """Puts, and deletes where the value is None, as one commit in order. An empty batch does nothing."""
        return self._append(self._small([(family, k, v, v is None, None, None) for k, v in ops])) if ops else self.manifest.last_seq

    # --- reads -------------------------------------------------------------------------------------------------------

    def get(self, key: bytes, at: int | None = None, family: str = "", now_ns: int | None = None) -> bytes:
        row = self._one(key, at, family, now_ns)
        if row.status == "FOUND":
            return bytes(row.value) if row.value is not None else None
        if row.status == "EXPIRED" and self.config.lazy_expiry and not self.read_only:
            self._expire(key, family, now_ns)
        raise (KeyDeleted if row.status == "DELETED" else KeyNotFound)(key)

    def _one(self, key: bytes, at: int | None = None, family: str = "", now_ns: int | None = None):
        """Status of one key; the key and the bound on seq are literals that the scan prunes row groups by."""
        runs = self.manifest.runs
        log = self._rows_of([r for r in runs if r.filter is None])
        for r in runs:
            if r.filter is not None and (part := self._holding(r, key)) is not None:
                log = log.unionByName(part.withColumns({"seq": F.col("n") + F.lit(r.base), "level": F.lit(r.level)}))
        log = log.where((F.col("kind") == DATA) & (F.col("family") == family) & (F.col("key") == F.lit(key)))
        dead = self._deadlines(family, key) if now_ns is not None else None
        return resolve.get_status(log, self.spark.createDataFrame([(key,)], "key binary"), at, dead, now_ns).first()

    def multi_get(self, wanted: DataFrame, at: int | None = None, family: str = "", now_ns: int | None = None) -> DataFrame:
        return resolve.get_status(self.log(family), wanted, at, self._deadlines(family) if now_ns is not None else None, now_ns)

    def scan(self, spec: scan.Scan | None = None, family: str = "", **options) -> DataFrame:
        spec = spec or scan.Scan(**options)
        return scan.scan(self.log(family), spec, self._deadlines(family) if spec.now_ns is not None else None)

    def prefix_scan(self, prefix: bytes, family: str = "", **options) -> DataFrame:
        """In the default family an empty prefix is an error; in others it means the whole family."""
        if not prefix and not family:
            raise ValueError("the prefix is empty")
        return self.scan(scan.Scan(prefix=prefix or None, **options), family)

    def seq_at(self, key: bytes, at: int, family: str = "") -> int:
        return resolve.seq_at(self.log(family), self.spark.createDataFrame([(key,)], "key binary"), at).first().seq

    def snapshot(self, shared: bool = False) -> Snapshot:
        return Snapshot(self, self.refresh().last_seq, shared)

    def stats(self) -> DataFrame:
        return merge.tier_stats(self._read())

    # --- transactions ------------------------------------------------------------------------------------------------

    def begin(self) -> Txn:
        self._writable()
        return Txn(self)

    # --- families ----------------------------------------------------------------------------------------------------

    def create_family(self, name: str) -> None:
        check_name(name)
        if name not in self.refresh().families:
            self._commit(lambda m: setattr(m, "families", sorted({*m.families, name})))

    def families(self) -> list[str]:
        return sorted(self.refresh().families)

    def _known(self, name: str) -> None:
        if name not in self.refresh().families:
            raise StoreError(f"no family {name!r}")

    def drop_family(self, name: str) -> None:
        """Tombstones for the family's live keys and deadlines, and its removal, in one commit."""
        self._known(name)
        dead = resolve.live(self.log(name)).select("key", F.lit(True).alias("tombstone"))
        gone = self._rows(dead, name, DATA).unionByName(self._rows(self._deadlines(name).select("key", F.lit(True).alias("tombstone")), name, TTL))
        with temporary(self.spark):
            self._append(number_rows(gone, [F.col("kind"), F.col("key")], "n"), families=lambda have: [f for f in have if f != name])

    # --- expiry ------------------------------------------------------------------------------------------------------

    def _ttl_log(self, family: str) -> DataFrame:
        return self._read(kind=TTL).where(F.col("family") == family)

    def _deadlines(self, family: str, key: bytes | None = None) -> DataFrame:
        rows = self._ttl_log(family)
        return ttl.deadlines(rows if key is None else rows.where(F.col("key") == F.lit(key)))

    def put_until(self, key: bytes, value: bytes, expire_at_ns: int, family: str = "") -> int:
        """Value and deadline in one commit."""
        return self._append(self._small([(family, key, value, False, None, DATA), (family, key, None, False, expire_at_ns, TTL)]))

    def put_with_ttl(self, key: bytes, value: bytes, ttl_ns: int, now_ns: int, family: str = "") -> int:
        if ttl_ns <= 0:
            raise ValueError("the time to live must be positive")
        return self.put_until(key, value, now_ns + ttl_ns, family)

    def expire_at(self, key: bytes, expire_at_ns: int, family: str = "") -> int:
        if expire_at_ns == 0:
            raise ValueError("the deadline is zero")
        return self._append(self._small([(family, key, None, False, expire_at_ns, TTL)]))

    def write_deadlines(self, rows: DataFrame, family: str = "") -> int:
        """Deadlines (key, expire_at_ns) of many keys as one commit; a null one clears the key's deadline."""
        marked = self._rows(rows.select("key", "expire_at_ns", F.col("expire_at_ns").isNull().alias("tombstone")), family, TTL)
        with temporary(self.spark):
            return self._append(number_rows(marked, [F.col("key")], "n"))

    def ttl_of(self, key: bytes, now_ns: int, family: str = "") -> int:
        row = ttl.remaining(self._ttl_log(family).where(F.col("key") == F.lit(key)), now_ns).first()
        if row is None:
            raise KeyNotFound(key)
        return row.remaining_ns

    def _expire(self, key: bytes, family: str, now_ns: int) -> None:
        """Deletes an expired key and its deadline, unless it was written or given a new deadline since it was read."""
        known = self.manifest.last_seq

        def check(m: Manifest) -> None:
            new = [r for r in m.runs if r.max_seq > known]
            if new and not self._rows_of(new).where((F.col("seq") > known) & (F.col("family") == family) & (F.col("key") == F.lit(key)) & F.col("kind").isin(DATA, TTL)).isEmpty():
                raise TxnConflict("the key was written")

        try:
            self._append(self._small([(family, key, None, True, None, DATA), (family, key, None, True, None, TTL)]), check)
        except TxnConflict:
            pass

    def reap(self, now_ns: int, family: str = "") -> int:
        """Deletes keys, and their deadlines, that are over; returns the last seq."""
        over = ttl.reap(self._ttl_log(family), now_ns).select("key", F.lit(True).alias("tombstone"))
        rows = self._rows(over, family, DATA).unionByName(self._rows(over, family, TTL))
        with temporary(self.spark):
            return self._append(number_rows(rows, [F.col("key"), F.col("kind")], "n"))

    # --- indexes -----------------------------------------------------------------------------------------------------

    def define_index(self, name: str, fn: KeyFn) -> None:
        """Definitions live in the session; entries that exist aren't touched and nothing is filled in."""
        check_name(name)
        if fn is None:
            raise ValueError("an index needs a key function")
        self._indexes[name] = fn

    def index(self, name: str) -> DataFrame:
        """Current entries (index_key, pk) of an index; none for an unknown one."""
        rows = self._read(kind=ENTRY).where(F.col("family") == name)
        return resolve.live(rows, ["key", "value"], columns=[]).select(F.col("value").alias("index_key"), F.col("key").alias("pk"))

    def _entry_rows(self, name: str, changes: DataFrame) -> DataFrame:
        return self._rows(changes.select(F.col("pk").alias("key"), F.col("index_key").alias("value"), (F.col("change") == "REMOVE").alias("tombstone")), name, ENTRY)

    def write_indexed(self, ops: DataFrame) -> int:
        """As write, for distinct keys, with the entries of all defined indexes in the same commit. Entries that an index holds
        for the keys go, those of the new values come."""
        rows = self._rows(ops, "", DATA)
        after = rows.select("key", "value", "tombstone")
        for name, fn in self._indexes.items():
            held = self.index(name).join(after.select(F.col("key").alias("k")), F.col("pk") == F.col("k"), "left_semi")
            want = after.where("not tombstone").select(F.col("key").alias("pk"), F.explode(F.array_distinct(fn(F.col("key"), F.col("value")).cast("array<binary>"))).alias("index_key")).where("index_key is not null")
            both = held.select("pk", "index_key", F.lit(-1).alias("s")).unionByName(want.select("pk", "index_key", F.lit(1).alias("s"))).groupBy("pk", "index_key").agg(F.sum("s").alias("s")).where("s <> 0")
            rows = rows.select(*[c for c in self._schema.fieldNames() if c != "n"]).unionByName(self._entry_rows(name, both.withColumn("change", F.when(F.col("s") > 0, "ADD").otherwise("REMOVE"))).select(*[c for c in self._schema.fieldNames() if c != "n"]))
        with temporary(self.spark):
            return self._append(number_rows(rows, [F.col("kind"), F.col("key"), F.col("value")], "n"))

    def put_indexed(self, key: bytes, value: bytes) -> int:
        return self.write_indexed(self.spark.createDataFrame([(key, value, False)], "key binary, value binary, tombstone boolean"))

    def delete_indexed(self, key: bytes) -> int:
        return self.write_indexed(self.spark.createDataFrame([(key, None, True)], "key binary, value binary, tombstone boolean"))

    def query_index(self, name: str, key: bytes) -> DataFrame:
        return index.point(self.index(name), key)

    def range_index(self, name: str, low: bytes, high: bytes | None) -> DataFrame:
        return index.between(self.index(name), low, high)

    def rebuild_index(self, name: str) -> int:
        """Replaces the entries of an index by those of all current records."""
        if name not in self._indexes:
            raise StoreError(f"no index {name!r}")
        fn = self._indexes[name]
        want = index.build(self.log(""), fn).select("pk", F.col("index_key").cast("binary").alias("index_key"))
        both = self.index(name).select("pk", "index_key", F.lit(-1).alias("s")).unionByName(want.withColumn("s", F.lit(1))).groupBy("pk", "index_key").agg(F.sum("s").alias("s")).where("s <> 0")
        rows = self._entry_rows(name, both.withColumn("change", F.when(F.col("s") > 0, "ADD").otherwise("REMOVE")))
        with temporary(self.spark):
            return self._append(number_rows(rows, [F.col("key"), F.col("value")], "n"))

    def drop_index(self, name: str) -> int:
        self._indexes.pop(name, None)
        rows = self._entry_rows(name, self.index(name).withColumn("change", F.lit("REMOVE")))
        with temporary(self.spark):
            return self._append(number_rows(rows, [F.col("key"), F.col("value")], "n"))

    # --- tiers -------------------------------------------------------------------------------------------------------

    def _fold(self, runs: list[Run], level: int, bottom: bool) -> Run:
        """One run of several: per row's identity (kind, family, key, and the index key of entries) what pins and the present
        see, sorted by key in ranges of the target file size."""
        pins = sorted({*(p.seq for p in self._pins), *self.manifest.pins.values()})
        rows = self._rows_of(runs).where(~F.col("kind").isin(BEGIN, COMMIT)).withColumn("n", F.col("seq"))
        name = F.when(F.col("kind") == ENTRY, F.col("value"))
        order = F.struct("n", "tombstone", "value", "expire_at_ns", "txn_id")
        kept = rows.withColumn("band", merge.band(pins)).groupBy("kind", "family", "key", name.alias("entry"), "band").agg(F.max(order).alias("v")).select("kind", "family", "key", "v.*")
        if bottom:
            kept = kept.where(~(F.col("tombstone") & (F.col("n") < (min(pins) if pins else merge.NOTHING_PINNED))))
        files = max(1, -(-sum(r.bytes for r in runs) // self.config.target_file_bytes))
        run = self._write_run(kept.select(*self._schema.fieldNames()).repartitionByRange(files, "kind", "family", "key").sortWithinPartitions("kind", "family", "key", F.col("n").desc()), level)
        run.latest_only = not pins
        return run

    def _replace(self, old: list[Run], level: int, bottom: bool) -> None:
        """Puts one run in the place of several. Fails with Raced if another process folded one of them meanwhile."""
        self._writable()
        if not old:
            return
        pinned, upto = set(self.manifest.pins), self.manifest.last_seq
        run = self._fold(old, level, bottom)
        gone = [r.path for r in old]

        def change(m: Manifest) -> None:
            self._present(m, run)
            if not set(gone) <= {r.path for r in m.runs}:
                raise Raced("the runs were folded by another writer")
            if any(seq < upto for p, seq in m.pins.items() if p not in pinned):
                raise Raced("a snapshot was pinned meanwhile")
            m.runs = [r for r in m.runs if r.path not in gone] + ([run] if run.rows else [])
            m.retired += gone
            if bottom:
                m.collected = max(m.collected, *(r.max_seq for r in old))

        self._commit(change)
        for path in gone:
            self.telemetry.remove(path)

    def flush(self) -> None:
        """Memory runs become one run of the first tier; that tier is compacted once it has enough runs."""
        self._writable()
        self._replace([r for r in self.refresh().runs if r.level == merge.MEM], merge.L0, bottom=False)
        if sum(r.level == merge.L0 for r in self.manifest.runs) >= self.config.l0_runs:
            self.compact()

    def full(self) -> bool:
        mem = [r for r in self.manifest.runs if r.level == merge.MEM]
        return len(mem) >= self.config.mem_runs or sum(r.bytes for r in mem) >= self.config.mem_bytes

    def flush_if_full(self) -> bool:
        """Every write ends with this. That another process flushes at the same time is no error."""
        if not self.full():
            return False
        try:
            self.flush()
        except Raced:
            self.refresh()
        return True

    def compact(self, to_bottom: bool = False) -> None:
        """First tier into the second, and the second into the bottom once it is large enough or if asked for. Tombstones go only
        at the bottom."""
        tier = lambda *levels: [r for r in self.refresh().runs if r.level in levels]
        if tier(merge.L0):
            self._replace(tier(merge.L0, merge.L1), merge.L1, bottom=False)
        if to_bottom or sum(r.bytes for r in tier(merge.L1)) >= self.config.l1_bytes:
            self._replace(tier(merge.L1, merge.L2), merge.L2, bottom=not any(r.level > merge.L2 for r in self.manifest.runs))

    def vacuum(self, grace_s: float | None = None) -> int:
        """Removes folded runs, and runs without a commit that are older than ``grace_s``; returns how many. They're named doomed in
        a manifest first, so that no commit can name them any more. Readers of older manifests must be done."""
        at = self._Path(self.folder + "/runs")
        oldest = time.time() - (self.config.grace_s if grace_s is None else grace_s)
        found = {f"runs/{s.getPath().getName()}": s.getModificationTime() / 1000 for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

        def change(m: Manifest) -> None:
            named = {r.path for r in m.runs}
            m.doomed = sorted(p for p, written in found.items() if p not in named and (p in m.retired or p in m.doomed or written < oldest))
            m.retired = sorted((set(m.retired) - set(m.doomed)) & set(found))

        doomed = self._commit(change).doomed if found else []
        for p in doomed:
            self._fs.delete(self._Path(f"{self.folder}/{p}"), True)
        return len(doomed)

    # --- backup and end ----------------------------------------------------------------------------------------------

    def backup(self, target: str, created_at: str) -> dict:
        """Flushes and copies the newest manifest and all files of its runs."""
        self.flush()
        if self.manifest.version == 0:
            self._commit(lambda m: None)
        names = [f"manifests/{self.manifest.version:020d}.json"]
        for r in self.manifest.runs:
            names += [f"{r.path}/{s.getPath().getName()}" for s in self._fs.listStatus(self._Path(f"{self.folder}/{r.path}")) if s.getPath().getName().endswith(".parquet")]
        return backup.backup(self.spark, self.folder, names, target, self.manifest.last_seq, created_at)

    def close(self) -> None:
        if not self._closed:
            if not self.read_only:
                self.flush()
            self._closed = True


class Txn:
    """An optimistic transaction over all families: reads its own writes, else its snapshot; commits if no key that it read has
    changed since. In the log its operations stand between a begin and a commit."""

    def __init__(self, store: Store):
        self.store, self.snapshot = store, store.snapshot()
        self.reads: dict[tuple[str, bytes], int] = {}
        self.writes: list[tuple[str, bytes, bytes | None]] = []
        self._own: dict[tuple[str, bytes], bytes | None] = {}
        self._open = True

    @property
    def snap_seq(self) -> int:
        return self.snapshot.seq

    @property
    def write_count(self) -> int:
        return len(self.writes)

    @property
    def read_count(self) -> int:
        """Keys that commit will validate."""
        return len(self.reads)

    def _check(self) -> None:
        if not self._open:
            raise TxnClosed("the transaction is over")

    def get(self, key: bytes, family: str = "") -> bytes | None:
        self._check()
        if (family, key) in self._own:
            if (value := self._own[family, key]) is None:
                raise KeyDeleted(key)
            return value
        row = self.store._one(key, self.snap_seq, family)
        self.reads.setdefault((family, key), row.seq or 0)
        if row.status != "FOUND":
            raise (KeyDeleted if row.status == "DELETED" else KeyNotFound)(key)
        return None if row.value is None else bytes(row.value)

    def put(self, key: bytes, value: bytes, family: str = "") -> None:
        self._buffer(key, value, family)

    def delete(self, key: bytes, family: str = "") -> None:
        self._buffer(key, None, family)

    def _buffer(self, key: bytes, value: bytes | None, family: str) -> None:
        self._check()
        if not key or len(key) > txn.MOST_KEY_BYTES:
            raise TxnTooLarge("a key must have 1 to 8192 bytes")
        if value is not None and len(value) > txn.MOST_VALUE_BYTES:
            raise TxnTooLarge("the value is too large")
        if len(self.writes) >= txn.MOST_OPS:
            raise TxnTooLarge("the transaction has too many operations")
        self.writes.append((family, key, value))
        self._own[family, key] = value

    def _conflict(self, m: Manifest) -> bool:
        """Whether a key that was read has a newer version in a manifest, or none any more. Where deletions since the snapshot may
        have been collected the whole log is read, else the runs since then are enough."""
        newer, folded = [r for r in m.runs if r.max_seq > self.snap_seq], m.collected > self.snap_seq
        if not self.reads or not (newer or folded):
            return False
        asked = self.store.spark.createDataFrame([(f, k, s) for (f, k), s in self.reads.items()], "f string, k binary, seen long")
        log = self.store._read(m.runs if folded else newer).where(F.col("family").isin(sorted({f for f, _ in self.reads})))
        on = (F.col("family") == F.col("f")) & (F.col("key") == F.col("k"))
        now = log.join(F.broadcast(asked.select("f", "k")), on, "left_semi").groupBy("family", "key").agg(F.max("seq").alias("now"))
        changed = F.col("now") > F.col("seen")
        return not asked.join(now, on, "left").where(F.coalesce(changed, F.col("seen") > 0) if folded else changed).isEmpty()

    def commit(self) -> int:
        self._check()
        store = self.store
        try:
            if not self.writes:
                return self.snap_seq

            def check(m: Manifest) -> None:
                if self._conflict(m):
                    raise TxnConflict("a key that was read has changed")

            mark = lambda kind: (None, None, None, False, None, kind)
            rows = store._small([*((f, k, v, v is None, None, None) for f, k, v in self.writes), mark(BEGIN), mark(COMMIT)])
            # The markers have the numbers of the first and the last operation.
            rows = rows.withColumn("n", F.when(F.col("kind") == BEGIN, 1).when(F.col("kind") == COMMIT, len(self.writes)).otherwise(F.col("n")).cast("long"))
            return store._append(rows.withColumn("txn_id", F.lit(store.refresh().last_txn + 1).cast("long")), check)
        finally:
            self._end()

    def rollback(self) -> None:
        self._check()
        self._end()

    def _end(self) -> None:
        self._open = False
        self.snapshot.release()
