"""Exactly one copy of each message of a stream that is delivered at least once.

A message is identified by its producer, the producer's sequence number and the fields that go with it. What has been seen
is kept as disjoint ranges of numbers per producer, with one 8-byte digest of the identifier per number; a range costs 8 bytes
a number however long keys are. An identifier whose number is covered under another digest, or that has no number at all, is
malformed and looked up exactly among the malformed ones seen before. A batch reads and writes the state of the buckets that it
touches only.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verslog.commits import CommitLog
from verslog.functions.hashing import maybe_in, row_hash
from verslog.session import discard, materialize, scratch

#: Numbers of a producer that one group holds.
BUCKET = 1 << 16
#: Steps whose states are kept side by side before they're folded into one.
FOLD = 8

_STEP = "producer string, bucket long, number long, last long, digest long, digests binary, first long, kind tinyint"
#: What a row of a step is: an accepted number, a range of the state, a number with other identifiers besides its own.
ACCEPTED, RANGE, ODD = 0, 1, 2


def merge_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges (both ends included) that cover the given ones; ranges that touch become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    start = np.append(True, lo[1:] > hi[:-1] + 1)
    return lo[start], hi[np.append(np.flatnonzero(start)[1:] - 1, len(hi) - 1)]


def _accept(own: pa.Table, seen: pa.Table) -> pa.Table:
    """Numbers of one (producer, bucket) against its seen ranges: the numbers that were uncovered, whose first message is accepted;
    the bucket's ranges, if there are such; and the numbers under which messages with another digest came than the one that holds it."""
    number, digest, first, least, most = (own.column(c).to_numpy() for c in ("number", "digest", "first", "least", "most"))
    order = np.argsort(number, kind="stable")
    number, digest, first, least, most = (x[order] for x in (number, digest, first, least, most))
    if seen.num_rows:  # the newest state of the bucket
        step = seen.column("step").to_numpy()
        seen = seen.filter(pa.array(step == step.max())).sort_by("number")
    lo, hi = seen.column("number").to_numpy(), seen.column("last").to_numpy()
    held = [np.frombuffer(x, dtype="<i8") for x in seen.column("digests").to_pylist()]
    start = np.concatenate([[0], np.cumsum(hi - lo + 1)]).astype(np.int64)
    flat = np.concatenate(held) if held else np.zeros(0, dtype=np.int64)
    at = np.searchsorted(lo, number, side="right") - 1
    covered = (at >= 0) & (number <= (hi[at] if len(hi) else -1))
    holder = digest.copy()
    holder[covered] = flat[start[at[covered]] + number[covered] - lo[at[covered]]]
    new, odd = ~covered, (least != holder) | (most != holder)
    new_lo, new_hi, digests = lo[:0], hi[:0], []
    if new.any():
        all_n = np.concatenate([*[np.arange(a, b + 1) for a, b in zip(lo, hi)], number[new]]).astype(np.int64)
        all_d = np.concatenate([flat, digest[new]])
        order = np.argsort(all_n, kind="stable")
        all_n, all_d = all_n[order], all_d[order]
        new_lo, new_hi = merge_ranges(np.concatenate([lo, number[new]]), np.concatenate([hi, number[new]]))
        digests = [all_d[a:b].astype("<i8").tobytes() for a, b in zip(np.searchsorted(all_n, new_lo), np.searchsorted(all_n, new_hi, side="right"))]
    k, r, o = int(new.sum()), len(new_lo), int(odd.sum())
    fill = lambda c: pa.array([own.column(c)[0].as_py()] * (k + r + o), own.schema.field(c).type)
    nothing = np.zeros(r + o, dtype=np.int64)
    return pa.table(
        {
            "producer": fill("producer"),
            "bucket": fill("bucket"),
            "number": np.concatenate([number[new], new_lo, number[odd]]).astype(np.int64),
            "last": np.concatenate([number[new], new_hi, number[odd]]).astype(np.int64),
            "digest": np.concatenate([np.zeros(k + r, dtype=np.int64), holder[odd]]).astype(np.int64),
            "digests": pa.array([None] * k + digests + [None] * o, pa.binary()),
            "first": pa.array(np.concatenate([first[new], nothing]).astype(np.int64), mask=np.concatenate([np.zeros(k, dtype=bool), nothing == 0])),
            "kind": np.repeat(np.array([ACCEPTED, RANGE, ODD], dtype=np.int8), [k, r, o]),
        }
    )


class SeenRanges:
    """State of a deduplicated stream in a folder: per step the ranges and the malformed identifiers that were accepted.

    ``apply`` takes the batch of a step and returns the ids of the messages to drop. A step is written under the path of its
    number and becomes the state by a commit file, so a step that failed is written anew, one that is repeated after its
    commit gives the same ids again, and another process goes on with the folder (as ``foreachBatch`` does, whose batch ids
    may serve as numbers). Columns: ``producer`` and ``identity`` may hold nulls, which equal nulls only; ``order`` is unique in
    the stream and of type long, and the smallest is kept.
    """

    def __init__(self, spark, producer: str, number: str, identity: list[str], order: str, bucket: int = BUCKET, folder: str | None = None, fold: int = FOLD):
        self.spark, self.producer, self.number, self.identity, self.order, self.bucket, self.fold = spark, producer, number, identity, order, bucket, fold
        self.folder = (folder or scratch(spark, "seen")).rstrip("/")
        self._log = CommitLog(spark, f"{self.folder}/steps")

    def _steps(self) -> list[int]:
        return [n for n in self._log.numbers() if self._log.read(n) is not None]

    def _parts(self, done: list[int]) -> list[int]:
        """Steps whose states together are the state."""
        return json.loads(self._log.read(done[-1]))["parts"] if done else []

    def narrow(self, batch: DataFrame) -> DataFrame:
        """The columns that are read of a batch, under names of their own."""
        ident = [F.col(c).alias(f"__i{i}") for i, c in enumerate(self.identity)]
        return batch.select(F.col(self.producer).cast("string").alias("producer"), F.col(self.number).cast("long").alias("number"), *ident, F.col(self.order).cast("long").alias("first"))

    def apply(self, batch: DataFrame, step: int | None = None) -> DataFrame:
        """``step`` grows from batch to batch; the default is the next number."""
        return self.apply_narrow(self.narrow(batch), step)

    def apply_narrow(self, rows: DataFrame, step: int | None = None) -> DataFrame:
        """As apply, for rows as ``narrow`` gives them. They're read three times, once for their order alone."""
        done = self._steps()
        step = (done[-1] + 1 if done else 0) if step is None else step
        at = f"{self.folder}/step-{step:012d}"
        if step not in done:
            if done and step < done[-1]:
                raise ValueError(f"step {step} comes after step {done[-1]}")
            parts = self._write(rows, at, step, done)
            self._log.create(step, json.dumps({"parts": parts}))
        accepted = self._kind(at, ACCEPTED).select("first").unionByName(self.spark.read.schema(rows.schema).parquet(f"{at}/malformed").select("first"))
        return rows.select(F.col("first").alias(self.order)).join(accepted.select(F.col("first").alias("a")), F.col(self.order) == F.col("a"), "left_anti")

    def _kind(self, at: str, kind: int) -> DataFrame:
        return self.spark.read.schema(_STEP).parquet(f"{at}/numbers").where(F.col("kind") == kind)

    def _write(self, rows: DataFrame, at: str, step: int, done: list[int]) -> list[int]:
        names = [c for c in rows.columns if c.startswith("__i")]
        digest = row_hash(*[F.col(n) for n in names])
        # Copies are counted out before the shuffle: a number is one row of longs per task, whatever its identifiers hold.
        own = rows.dropna(subset=["producer", "number"]).withColumn("digest", digest).groupBy("producer", "number")
        own = own.agg(F.min_by("digest", "first").alias("digest"), F.min("first").alias("first"), F.min("digest").alias("least"), F.max("digest").alias("most"))
        own = own.withColumn("bucket", F.floor(F.col("number") / self.bucket))
        state, parts = self._state(done), self._parts(done)
        if parts:  # of the state only the buckets of the batch's numbers are shuffled
            own = materialize(own, "numbers")
            state = maybe_in(state, F.xxhash64("producer", "bucket"), own.select(F.xxhash64("producer", "bucket").alias("h")).distinct(), F.col("h"))
        own.groupBy("producer", "bucket").cogroup(state.groupBy("producer", "bucket")).applyInArrow(_step, _STEP).write.mode("overwrite").partitionBy("kind").parquet(f"{at}/numbers")
        # A malformed identifier has no number, or one that stands for another identifier. The few odd numbers are a table of their
        # own, so their messages are found without shuffling the batch.
        held = self._kind(at, ODD).select(F.col("producer").alias("p"), F.col("number").alias("n"), F.col("digest").alias("d"))
        met = rows.join(held, (F.col("producer") == F.col("p")) & (F.col("number") == F.col("n")), "left")
        odd = met.where(F.col("producer").isNull() | F.col("number").isNull() | (digest != F.col("d"))).groupBy("producer", "number", *names).agg(F.min("first").alias("first"))
        if done:
            before = self.spark.read.schema(rows.schema).parquet(*[f"{self.folder}/step-{n:012d}/malformed" for n in done])
            before = before.select(*[F.col(c).alias(f"b{c}") for c in ("producer", "number", *names)])
            odd = odd.join(before, [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in ("producer", "number", *names)], "left_anti")
        odd.select(*rows.columns).write.mode("overwrite").parquet(f"{at}/malformed")
        if len(parts) + 1 < self.fold:
            return [*parts, step]
        # The newest state of every bucket, as one.
        all_of = self._ranges([*parts, step], step, at)
        newest = all_of.groupBy("producer", "bucket").agg(F.max("step").alias("s")).select(F.col("producer").alias("p"), F.col("bucket").alias("b"), "s")
        kept = all_of.join(newest, (F.col("producer") == F.col("p")) & (F.col("bucket") == F.col("b")) & (F.col("step") == F.col("s")))
        kept.select("producer", "bucket", "number", "last", "digests").write.mode("overwrite").parquet(f"{at}/folded")
        return [-step - 1]

    def _ranges(self, parts: list[int], step: int | None = None, at: str | None = None) -> DataFrame:
        """Ranges of the states of some steps (a folded one is -step - 1) with their step; a bucket may have several states."""
        rows = self.spark.createDataFrame([], _STEP).select("producer", "bucket", "number", "last", "digests", F.lit(0).cast("long").alias("step"))
        for p in parts:
            folder = f"{self.folder}/step-{p if p >= 0 else -p - 1:012d}"
            part = self._kind(folder, RANGE) if p >= 0 else self.spark.read.schema(_STEP).parquet(f"{folder}/folded")
            rows = rows.unionByName(part.select("producer", "bucket", "number", "last", "digests", F.lit(p if p >= 0 else -p - 1).cast("long").alias("step")))
        return rows

    def _state(self, done: list[int]) -> DataFrame:
        return self._ranges(self._parts(done))

    def ranges(self) -> DataFrame:
        """The seen ranges (producer, first number, last number)."""
        rows = self._state(self._steps())
        newest = rows.groupBy("producer", "bucket").agg(F.max("step").alias("s")).select(F.col("producer").alias("p"), F.col("bucket").alias("b"), "s")
        return rows.join(newest, (F.col("producer") == F.col("p")) & (F.col("bucket") == F.col("b")) & (F.col("step") == F.col("s"))).select("producer", F.col("number").alias("lo"), F.col("last").alias("hi"))

    def close(self) -> None:
        """Removes the state."""
        discard(self.spark, self.folder)


def _step(own: pa.Table, seen: pa.Table) -> pa.Table:
    """Buckets that the batch doesn't touch are left as they are."""
    return _accept(own, seen) if own.num_rows else _NOTHING


_NOTHING = pa.schema(
    [("producer", pa.string()), ("bucket", pa.int64()), ("number", pa.int64()), ("last", pa.int64()), ("digest", pa.int64()), ("digests", pa.binary()), ("first", pa.int64()), ("kind", pa.int8())]
).empty_table()


def drop_repeats(stream: DataFrame, producer: str, number: str, identity: list[str], order: str, batches: int = 2) -> DataFrame:
    """Ids (``order``) of all copies but the first of each message, of a whole stream taken in batches of delivery.

    Rows without an id can't be named and are left out; an empty stream gives no ids. Long identifiers and extra columns of
    any name don't matter: an identifier is 8 bytes in the state. The stream is read once and written by batches."""
    seen = SeenRanges(stream.sparkSession, producer, number, identity, order)
    low, high = stream.agg(F.min(order), F.max(order)).first()
    if low is None:
        return stream.select(F.col(order).cast("long").alias(order))
    size = (high - low) // batches + 1
    rows = seen.narrow(stream).where("first is not null")
    rows = materialize(rows.withColumn("__batch", F.floor((F.col("first") - low) / size).cast("int")), "deliveries", "__batch")
    drops = [seen.apply_narrow(rows.where(F.col("__batch") == i).drop("__batch")) for i in range(batches)]
    out = drops[0]
    for d in drops[1:]:
        out = out.unionByName(d)
    return out
