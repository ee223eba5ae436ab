"""Has this key been seen before? Sealed sets of keys as minimal perfect hashes with fingerprints.

Earlier keys are split by hash into sealed partitions. Each holds a minimal perfect hash function (a cascade of bit arrays:
a key's slot is the rank of the first bit that it alone hit) and one fingerprint per slot, about 36 bits a key at 32-bit
fingerprints, whatever the keys' length. A key of the set always finds its own fingerprint, so no seen key is missed; a new
key that meets a slot by chance is answered wrongly with probability 2^-bits, for each generation that it is held against. The
current batch is resolved exactly. ``SealedKeys`` keeps sealed partitions in a folder, so a batch reads them and itself, never the
earlier keys.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verslog.commits import CommitLog
from verslog.session import discard, scratch

#: Keys of a sealed partition: the arrays of one take some tens of MB while it is built or probed.
PARTITION_KEYS = 1 << 20
FINGERPRINT_BITS = 32
#: Bits of a level per key that is left; fewer make the structure smaller and the cascade longer.
GAMMA = 2.0

_INDEX = "part long, generation int, keys long, sizes string, bits binary, fingerprints binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(h1 + np.uint64((level * 0x9E3779B97F4A7C15 + 1) % 2**64) * (h2 | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mix(h2 ^ _mix(h1 + np.uint64(0x5851F42D4C957F2D))) >> np.uint64(32)).astype(np.uint32)


def build_sealed(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Level sizes, bits and fingerprints for distinct 128-bit keys given as two unsigned words."""
    sizes, bits, level = [], [], 0
    left = np.arange(len(h1))
    while len(left):
        size = int(np.ceil(GAMMA * len(left)))
        at = _place(h1[left], h2[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left, level = left[~alone[at]], level + 1
        if level > 200:
            raise ValueError("keys are not distinct")
    flat = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    prints = np.zeros(len(h1), dtype="<u4")
    slot, _ = find_slots(h1, h2, sizes, flat)
    prints[slot] = _fingerprint(h1, h2)
    return sizes, np.packbits(flat).tobytes(), prints.tobytes()


def find_slots(h1: np.ndarray, h2: np.ndarray, sizes: list[int], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each key, and whether it has one; keys of the set have distinct slots 0..n-1."""
    rank = np.cumsum(flat) - 1
    slot, left, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = base + _place(h1[left], h2[left], level, size)
        hit = flat[at]
        slot[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slot, slot >= 0


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _part(partitions: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(partitions).cast("long")).alias("part")


def seal(keys: DataFrame, key: str, partitions: int, generation: int = 0) -> DataFrame:
    """One row per partition of the distinct non-null keys. Repeats are dropped before the shuffle; a partition is sized by
    distinct keys, so a key that fills a third of the rows doesn't matter. Later generations may be appended to the table."""
    return seal_hashes(keys.where(F.col(key).isNotNull()).select(*_hashes(F.col(key))), partitions, generation)


def seal_hashes(hashes: DataFrame, partitions: int, generation: int = 0) -> DataFrame:
    """As seal, of the hashes (h1, h2) of keys."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = _words(table)
        sizes, bits, prints = build_sealed(h1, h2)
        row = {"part": [table.column("part")[0].as_py()], "generation": [generation], "keys": [len(h1)], "sizes": [json.dumps(sizes)], "bits": [bits], "fingerprints": [prints]}
        return pa.table(row, schema=pa.schema([("part", pa.int64()), ("generation", pa.int32()), ("keys", pa.int64()), ("sizes", pa.string()), ("bits", pa.binary()), ("fingerprints", pa.binary())]))

    rows = hashes.select("h1", "h2").distinct()
    return rows.withColumn("part", _part(partitions)).groupBy("part").applyInArrow(build, _INDEX)


def probe(batch: DataFrame, key: str, order: str, index: DataFrame, partitions: int) -> DataFrame:
    """(order, h1, h2, matched) for rows with distinct keys: the key's hashes, and how many low fingerprint bits agree at the key's
    slot, the most of all generations; -1 without a slot. A key of the index gives 32. Index and batch meet partition by partition."""

    def look(rows: pa.Table, sealed: pa.Table) -> pa.Table:
        h1, h2 = _words(rows)
        best = np.full(len(h1), -1, dtype=np.int32)
        own = _fingerprint(h1, h2)
        for i in range(sealed.num_rows if len(h1) else 0):
            sizes = json.loads(sealed.column("sizes")[i].as_py())
            flat = np.unpackbits(np.frombuffer(sealed.column("bits")[i].as_py(), dtype=np.uint8), count=sum(sizes)).astype(bool)
            prints = np.frombuffer(sealed.column("fingerprints")[i].as_py(), dtype="<u4")
            slot, has = find_slots(h1, h2, sizes, flat)
            differ = own[has] ^ prints[slot[has]]
            lowest = np.where(differ == 0, 32, np.log2(np.maximum(differ & (~differ + np.uint32(1)), 1)).astype(np.int32))
            best[has] = np.maximum(best[has], lowest)
        return pa.table({order: rows.column(order), "h1": rows.column("h1"), "h2": rows.column("h2"), "matched": best})

    rows = batch.select(F.col(order).cast("long").alias(order), *_hashes(F.col(key))).withColumn("part", _part(partitions))
    return rows.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(look, f"{order} long, h1 long, h2 long, matched int")


def partitions_for(*tables: DataFrame) -> int:
    """Sealed partitions for the largest of some tables (counts of Parquet rows come from the footers)."""
    return max(1, *(-(-t.count() // PARTITION_KEYS) for t in tables), tables[0].sparkSession.sparkContext.defaultParallelism)


def first_arrivals(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The exact set of the current batch: each non-null key with the smallest order at which it came."""
    return incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


class SealedKeys:
    """A durable set of keys in a folder that is only added to.

    A step writes the hashes of its new keys (16 bytes each, with the order at which they came) and their sealed partitions (about 36
    bits each) under the path of its number, and becomes part of the set by a commit file: a step that failed is written anew,
    one that is repeated after its commit gives the same answers again. Each step is a generation. Once there are ``most``
    of them they're merged: sealed anew from their hashes, with as many partitions as all keys need. A key that a batch takes for seen
    by mistake isn't added, and later ones of it are answered the same way.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, most: int = 8, bits: int = FINGERPRINT_BITS):
        self.spark, self.most, self.bits = spark, most, bits
        self.folder = (folder or scratch(spark, "sealed")).rstrip("/")
        self._log = CommitLog(spark, f"{self.folder}/steps")

    def _state(self) -> dict:
        """The newest step, its partitions, the generations to probe (each a folder) and the steps whose hashes they hold."""
        for n in reversed(self._log.numbers()):
            if (text := self._log.read(n)) is not None:
                return {"step": n} | json.loads(text)
        return {"step": -1, "partitions": 0, "sealed": [], "steps": []}

    def generations(self) -> int:
        return len(self._state()["sealed"])

    def _index(self, state: dict) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in state["sealed"]]
        return self.spark.read.schema(_INDEX).parquet(*paths) if paths else self.spark.createDataFrame([], _INDEX)

    def _first(self, batch: DataFrame, key: str, order: str, state: dict) -> DataFrame:
        return probe(first_arrivals(batch, key, order), key, order, self._index(state), max(1, state["partitions"]))

    def _answer(self, batch: DataFrame, key: str, order: str, new: DataFrame) -> DataFrame:
        """All rows but the new first arrivals: an anti-join on the unique order, so rows of a hot key never meet in one task."""
        return batch.where(F.col(key).isNotNull()).select(order).join(new.select(F.col(order).alias("__new")), F.col(order) == F.col("__new"), "left_anti")

    def seen(self, batch: DataFrame, key: str, order: str) -> DataFrame:
        """Rows (order) whose key is in the set or came in the batch with a smaller order. Nothing is added."""
        return self._answer(batch, key, order, self._first(batch, key, order, self._state()).where(F.col("matched") < self.bits))

    def apply(self, batch: DataFrame, key: str, order: str, step: int | None = None) -> DataFrame:
        """As seen, and adds the batch's keys. ``step`` grows from batch to batch; the default is the next number."""
        state = self._state()
        step = state["step"] + 1 if step is None else step
        at = f"{self.folder}/step-{step:012d}"
        if step > state["step"]:
            if not state["partitions"]:
                state["partitions"] = partitions_for(batch)
            self._first(batch, key, order, state).where(F.col("matched") < self.bits).select(order, "h1", "h2").write.mode("overwrite").parquet(f"{at}/new")
            self._seal(step, [*state["steps"], step], state, at)
        elif self._log.read(step) is None:
            raise ValueError(f"step {step} comes after step {state['step']}")
        return self._answer(batch, key, order, self.spark.read.parquet(f"{at}/new"))

    def hold(self, keys: DataFrame, key: str) -> None:
        """Adds keys without an answer: the first step, from keys in any number and order."""
        state = self._state()
        if state["step"] >= 0:
            raise ValueError("the set has steps already; apply adds to it")
        at = f"{self.folder}/step-{0:012d}"
        keys.where(F.col(key).isNotNull()).select(*_hashes(F.col(key))).distinct().write.mode("overwrite").parquet(f"{at}/new")
        state["partitions"] = partitions_for(self.spark.read.parquet(f"{at}/new"))
        self._seal(0, [0], state, at)

    def _hashes_of(self, steps: list[int]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long").parquet(*[f"{self.folder}/step-{n:012d}/new" for n in steps])

    def _seal(self, step: int, steps: list[int], state: dict, at: str) -> None:
        sealed, name = state["sealed"], f"step-{step:012d}/sealed"
        merged = len(sealed) + 1 >= self.most
        rows = self._hashes_of(steps if merged else [step])
        partitions = partitions_for(rows) if merged else state["partitions"]
        seal_hashes(rows, partitions, step).write.mode("overwrite").parquet(f"{at}/sealed")
        self._log.create(step, json.dumps({"partitions": partitions, "sealed": [name] if merged else [*sealed, name], "steps": steps}))

    def close(self) -> None:
        """Removes the set."""
        discard(self.spark, self.folder)


def seen_before(earlier: DataFrame, incoming: DataFrame, key: str, order: str, bits: int = FINGERPRINT_BITS, batches: int = 0, folder: str | None = None) -> DataFrame:
    """Rows (order) of ``incoming`` whose key is in ``earlier`` or came with a smaller order; order is unique.

    Null keys are never seen. Keys are compared as whole bytes within the batch, by fingerprint against earlier ones: with
    32 bits one in 4 billion new keys is taken for seen, no seen key for new (p1_error_rate measures it). An empty ``earlier``
    leaves repeats within the batch, an empty batch gives nothing. Other columns aren't read.

    ``earlier`` is sealed once. With ``batches`` the arrivals are taken in so many ranges of their order, each of which adds its keys
    to the set before the next is asked; without they're one batch that adds nothing. Only the first arrival of each key can be new,
    so the answer is all rows but the new first arrivals.
    """
    keys = SealedKeys(incoming.sparkSession, folder, bits=bits)
    keys.hold(earlier, key)
    if not batches:
        return keys.seen(incoming, key, order)
    low, high = incoming.agg(F.min(order), F.max(order)).first()
    if low is None:
        return incoming.select(order)
    size = (high - low) // batches + 1
    parts = [keys.apply(incoming.where((F.col(order) >= low + i * size) & (F.col(order) < low + (i + 1) * size)), key, order) for i in range(batches)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_rate(earlier: DataFrame, incoming: DataFrame, key: str, order: str, widths: tuple[int, ...] = (8, 16, 32), generations: int = 1) -> DataFrame:
    """For fingerprints of several widths: keys asked, keys that are new in truth, wrong answers among these and their rate, with the
    earlier keys in so many generations. Truth is an exact join of the batch's keys with the earlier ones."""
    partitions = partitions_for(earlier, incoming)
    first = first_arrivals(incoming, key, order)
    index = None
    for g in range(generations):
        part = seal(earlier.where(F.pmod(F.hash(key), F.lit(generations)) == g), key, partitions, g)
        index = part if index is None else index.unionByName(part)
    matched = probe(first, key, order, index, partitions).select(order, "matched")
    known = first.join(earlier.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi").select(F.col(order).alias("__o"), F.lit(True).alias("known"))
    both = matched.join(known, F.col(order) == F.col("__o"), "left").withColumn("new", F.col("known").isNull())
    each = both.select("new", "matched", F.explode(F.array(*map(F.lit, widths))).alias("fingerprint_bits"))
    wrong = F.col("new") & (F.col("matched") >= F.col("fingerprint_bits"))
    missed = ~F.col("new") & (F.col("matched") < F.col("fingerprint_bits"))
    return each.groupBy("fingerprint_bits").agg(
        F.count("*").alias("asked"), F.count_if("new").alias("new_keys"), F.count_if(wrong).alias("wrong"), F.count_if(missed).alias("missed"), F.coalesce(F.try_divide(F.count_if(wrong), F.count_if("new")), F.lit(0.0)).alias("wrong_rate")
    )
