"""Bloom filters: sizing, exact bits, telemetry and adaptive false-positive rates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: FNV-1a, 64 bits; the odd constants of the second hash; the rates of the adaptive target.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FPR_TARGET, FPR_MIN, FPR_MAX = 0.01, 0.001, 0.05
LEAST_QUERIES = 100
#: Bits of a filter that a task puts together: 64 MB.
MOST_BITS = 1 << 29
#: Bytes of filters that a task holds while it builds them; one filter more than that is emitted batch by batch.
HELD_BYTES = 128 << 20


def size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at false-positive rate p."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, int(math.floor(m / n * math.log(2) + 0.5)))


def size_columns(n: Column, p: Column) -> tuple[Column, Column]:
    m = F.ceil(-n * F.log(p) / F.lit(math.log(2) ** 2))
    return m, F.greatest(F.lit(1), F.round(m / n * F.lit(math.log(2))).cast("int"))


def theoretical_rate(n: Column, m: Column, k: Column) -> Column:
    return F.pow(1 - F.exp(-k * n / m), k)


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit hashes of many keys, a byte position at a time over all keys long enough."""
    n = np.array([len(k) for k in keys], dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    flat = np.frombuffer(b"".join(keys), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(n)])[:-1][order]
    lengths = n[order]
    h = np.full(len(keys), FNV_OFFSET, dtype=np.uint64)
    for i in range(int(n.max()) if len(n) else 0):
        live = int(np.searchsorted(-lengths, -i, side="left"))
        h[:live] = (h[:live] ^ flat[start[:live] + i]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    g = out ^ np.uint64(GOLDEN)
    g = (g ^ (g >> np.uint64(30))) * np.uint64(MIX_1)
    g = (g ^ (g >> np.uint64(27))) * np.uint64(MIX_2)
    return out, g ^ (g >> np.uint64(31))


def positions(keys: list[bytes], m: int, k: int) -> np.ndarray:
    """Bit numbers of each key, one column per hash function; sums wrap around at 64 bits."""
    h1, h2 = hashes(keys)
    return ((h1[:, None] + np.arange(k, dtype=np.uint64) * h2[:, None]) % np.uint64(m)).astype(np.int64)


def _bytes(column: pa.ChunkedArray) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else bytes(x) for x in column.to_pylist()]


def build(rows: DataFrame, file: str, key: str, m: int, k: int) -> DataFrame:
    """(file, word, bits): 64-bit words of each file's filter that aren't zero. Words are put together per task, as far as
    filters fit HELD_BYTES, and combined with OR, so the shuffle carries words, not keys."""
    n_words = (m + 63) // 64

    def emit(held: dict[str, np.ndarray]):
        for name, flat in held.items():
            word = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(word), pa.string()), pa.array(word), pa.array(flat[word].view(np.int64))], names=["file", "word", "bits"])

    def words(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            names = pc.unique(t.column("file")).to_pylist()
            for name in names:
                keys = t.column("key") if len(names) == 1 else t.filter(pc.equal(t.column("file"), name) if name is not None else pc.is_null(t.column("file"))).column("key")
                at = positions(_bytes(keys), m, k).ravel()
                order = np.argsort(at, kind="stable")
                word, bits = at[order] >> 6, np.uint64(1) << (at[order] & 63).astype(np.uint64)
                start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                if name not in held and 8 * n_words * (len(held) + 1) > HELD_BYTES:
                    yield from emit(held)
                    held = {}
                flat = held.setdefault(name, np.zeros(n_words, dtype=np.uint64))
                flat[word[start]] |= np.bitwise_or.reduceat(bits, start)
        yield from emit(held)

    made = rows.where(F.col(key).isNotNull()).select(F.col(file).cast("string").alias("file"), F.col(key).alias("key")).mapInArrow(words, "file string, word long, bits long")
    return made.groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))


def probe(filters: DataFrame, asked: DataFrame, m: int, k: int, salts: int = 8) -> DataFrame:
    """(file, key) of asked rows (file, key) whose bits are all set in the file's filter: it may hold the key. Null keys are in
    no file, repeated rows are asked once.

    A file's filter and its share of the keys meet in one group per file and salt, so the keys of a large file are several
    tasks. Filters beyond MOST_BITS aren't put together: their words are joined with the keys' bits instead.
    """
    rows = asked.where("key is not null").select(F.col("file").cast("string").alias("file"), "key").distinct()
    kind = dict(asked.dtypes)["key"]
    if m > MOST_BITS:
        return _probe_words(filters, rows, kind, m, k)

    def test(keys: pa.Table, words: pa.Table) -> pa.Table:
        flat = np.zeros((m + 63) // 64, dtype=np.uint64)
        flat[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        at = positions(_bytes(keys.column("key")), m, k)
        held = ((flat[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
        return keys.select(["file", "key"]).filter(pa.array(held))

    keyed = rows.withColumn("salt", F.pmod(F.hash("key"), F.lit(salts)))
    spread = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.groupBy("file", "salt").cogroup(spread.groupBy("file", "salt")).applyInArrow(test, f"file string, key {kind}")


def _probe_words(filters: DataFrame, rows: DataFrame, kind: str, m: int, k: int) -> DataFrame:
    def spread(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            at = positions(_bytes(t.column("key")), m, k)
            which = pa.array(np.repeat(np.arange(t.num_rows), k))
            yield pa.RecordBatch.from_arrays([t.column("file").combine_chunks().take(which), t.column("key").combine_chunks().take(which), pa.array((at >> 6).ravel()), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).ravel().view(np.int64))], names=["file", "key", "w", "b"])

    bits = rows.mapInArrow(spread, f"file string, key {kind}, w long, b long")
    hit = bits.join(filters.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & (F.col("w") == F.col("word")), "left")
    return hit.groupBy("file", "key").agg(F.bool_and(F.coalesce((F.col("bits").bitwiseAND(F.col("b"))) == F.col("b"), F.lit(False))).alias("maybe")).where("maybe").select("file", "key")


def to_bytes(words: dict[int, int], m: int, k: int) -> bytes:
    """Serialised filter: bits and hash functions as 32-bit numbers, then all words, little-endian."""
    flat = np.zeros((m + 63) // 64, dtype="<u8")
    for w, b in words.items():
        flat[w] = b % 2**64
    return np.array([m, k], dtype="<u4").tobytes() + flat.tobytes()


def from_bytes(raw: bytes) -> tuple[int, int, np.ndarray]:
    m, k = (int(x) for x in np.frombuffer(raw[:8], dtype="<u4"))
    return m, k, np.frombuffer(raw[8:], dtype="<u8")


def telemetry(events: DataFrame) -> DataFrame:
    """(file, queries, false_positives, observed_fpr) from events (file, is_false_positive)."""
    got = events.groupBy("file").agg(F.count("*").alias("queries"), F.count_if("is_false_positive").alias("false_positives"))
    return got.withColumn("observed_fpr", F.coalesce(F.try_divide("false_positives", "queries"), F.lit(0.0)))


def recommend(queries: Column, false_positives: Column, target: Column) -> Column:
    """Next target rate: the same below LEAST_QUERIES queries; half of it if more were observed, twice if less than a quarter
    was, within the limits."""
    seen = F.coalesce(F.try_divide(false_positives, queries), F.lit(0.0))
    moved = F.when(seen > target, target * 0.5).when(seen < target * 0.25, target * 2).otherwise(target)
    return F.when(queries < LEAST_QUERIES, target).otherwise(F.greatest(F.lit(FPR_MIN), F.least(F.lit(FPR_MAX), moved)))


class Telemetry:
    """What filters answered in this process: per file how often one said that it may hold a key, and how often it didn't."""

    def __init__(self):
        self._files: dict[str, list[int]] = {}

    def record(self, file: str, queries: int = 1, false_positives: int = 0) -> None:
        have = self._files.setdefault(file, [0, 0])
        have[0] += queries
        have[1] += false_positives

    def stats(self, file: str) -> tuple[int, int] | None:
        """(queries, false positives), or None for a file that wasn't asked."""
        return tuple(self._files[file]) if file in self._files else None

    def remove(self, file: str) -> None:
        self._files.pop(file, None)

    def aggregate(self) -> tuple[int, int]:
        return sum(q for q, _ in self._files.values()), sum(f for _, f in self._files.values())

    def rate(self, target: float) -> float:
        """The rate for the next filter, as ``recommend`` gives it for all files together."""
        queries, wrong = self.aggregate()
        if queries < LEAST_QUERIES:
            return target
        seen = wrong / queries
        return max(FPR_MIN, min(FPR_MAX, target * 0.5 if seen > target else target * 2 if seen < target * 0.25 else target))


def maybe_files(filters: DataFrame, key: bytes, m: int, k: int) -> DataFrame:
    """(file) of the filters (file, word, bits) that may hold a key; the key's words are a condition that reads of sorted words prune by."""
    at = positions([key], m, k)[0]
    want = [(int(p) >> 6, int(np.uint64(1 << (int(p) & 63)).astype(np.int64))) for p in at]
    hits = [F.max((F.col("word") == w) & (F.col("bits").bitwiseAND(F.lit(b).cast("long")) != 0)).alias(f"b{i}") for i, (w, b) in enumerate(want)]
    found = filters.where(F.col("word").isin(sorted({w for w, _ in want}))).groupBy("file").agg(*hits)
    return found.where(" and ".join(f"b{i}" for i in range(len(want)))).select("file")
