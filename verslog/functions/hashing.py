"""Hashes of nullable columns in which NULL differs from every value and columns can't run into each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(*columns: Column, seed: int = 0) -> Column:
    """64-bit hash of the columns in order. ``xxhash64`` skips NULLs, so the null flag of each column is hashed too."""
    parts: list[Column] = [F.lit(seed)]
    for c in columns:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


#: 64-bit words of a filter that is broadcast: at most that many rows of two longs, some 10 MB.
FILTER_WORDS = 1 << 18


def maybe_in(rows: DataFrame, digest: Column, wanted: DataFrame, wanted_digest: Column, words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose 64-bit digest may be among those of ``wanted``, and all whose digest is: a filter of one bit a digest over a fixed
    number of words is broadcast, so its size doesn't grow with what is wanted; the more is wanted, the more others pass. To be
    followed by an exact join, whose shuffle then carries little else than what matches. Null digests pass never."""
    word, bit = lambda c: F.pmod(c, F.lit(words).cast("long")), lambda c: F.shiftrightunsigned(c, 58).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))
    bits = wanted.select(word(wanted_digest).alias("__w"), one(wanted_digest).alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__b"))
    marked = rows.withColumns({"__word": word(digest), "__bit": one(digest)})
    return marked.join(F.broadcast(bits), F.col("__word") == F.col("__w")).where(F.col("__b").bitwiseAND(F.col("__bit")) != 0).drop("__word", "__bit", "__w", "__b")
