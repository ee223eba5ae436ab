"""Range scans of a log."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verslog.functions.keys import prefix_bound
from verslog.operators.order import number_rows
from verslog.operators.resolve import newest


@dataclass(frozen=True)
class Scan:
    """What a scan reads. A prefix overrides both bounds; snapshot 0 is now; deadlines are applied only if ``now_ns`` is set."""

    lower: str | bytes | None = None
    upper: str | bytes | None = None
    prefix: str | bytes | None = None
    reverse: bool = False
    snapshot: int = 0
    tombstones: bool = False
    limit: int | None = None
    now_ns: int | None = None


def bounds(df: DataFrame, scan: Scan, key: str = "key") -> DataFrame:
    """Rows within [lower, upper), as comparisons that Parquet can skip row groups by."""
    low, high = (scan.lower, scan.upper) if not scan.prefix else (scan.prefix, prefix_bound(scan.prefix))
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(key) < F.lit(high))
    return df


def scan(log: DataFrame, spec: Scan, deadlines: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """(key, value, seq, tombstone) of the newest versions in key order. Bounds and snapshot are applied to the versions
    first, then the newest is taken, then tombstones go: a deletion hides every older version. With a limit only the first
    or, in reverse, last rows are kept, by a top-k without a full sort."""
    rows = newest(bounds(log, spec), at=spec.snapshot or None)
    if not spec.tombstones:
        rows = rows.where("not tombstone")
    if spec.now_ns is not None and deadlines is not None:
        over = deadlines.where(F.col("expire_at_ns") <= spec.now_ns).select(F.col("key").alias("__k"))
        rows = rows.join(over, F.col("key") == F.col("__k"), "left_anti")
    rows = rows.select("key", "value", "seq", "tombstone")
    if ordered or spec.limit is not None:
        rows = rows.orderBy(F.col("key").desc() if spec.reverse else F.col("key").asc())
    return rows if spec.limit is None else rows.limit(spec.limit)


def neighbours(rows: DataFrame) -> DataFrame:
    """(key, prev_key, next_key) for rows of distinct keys: where a cursor on each key moves to. Rows are numbered over ranges of
    keys and meet their neighbours by number."""
    n = number_rows(rows.select("key"), [F.col("key")], "n")
    both = n.select(F.col("n").alias("at"), F.struct(F.lit(0).alias("side"), F.col("key").alias("key")).alias("x"))
    both = both.unionByName(n.select((F.col("n") + 1).alias("at"), F.struct(F.lit(-1).alias("side"), F.col("key").alias("key")).alias("x")))
    both = both.unionByName(n.select((F.col("n") - 1).alias("at"), F.struct(F.lit(1).alias("side"), F.col("key").alias("key")).alias("x")))
    pick = lambda side: F.max(F.when(F.col("x.side") == side, F.col("x.key")))
    return both.groupBy("at").agg(pick(0).alias("key"), pick(-1).alias("prev_key"), pick(1).alias("next_key"), F.count_if(F.col("x.side") == 0).alias("own")).where("own > 0").select("key", "prev_key", "next_key")


class Cursor:
    """Steps through an ordered scan row by row, a partition at a time on the driver. ``prev`` goes back over the last ``back``
    rows, which are all that is kept."""

    def __init__(self, rows: DataFrame, back: int = 1000):
        self._source, self._kept, self._at, self._over = rows.toLocalIterator(prefetchPartitions=True), deque(maxlen=back + 1), -1, False
        self.next()

    @property
    def valid(self) -> bool:
        return 0 <= self._at < len(self._kept)

    @property
    def row(self):
        if not self.valid:
            raise IndexError("the cursor is beyond the scan")
        return self._kept[self._at]

    def next(self) -> bool:
        if self._at + 1 >= len(self._kept) and not self._over:
            if (row := next(self._source, None)) is None:
                self._over = True
            else:
                self._kept.append(row)
                self._at = len(self._kept) - 2
        self._at = min(self._at + 1, len(self._kept))
        return self.valid

    def prev(self) -> bool:
        self._at = max(self._at - 1, -1)
        return self.valid


def prefix_scan(log: DataFrame, prefix: str | bytes, **options) -> DataFrame:
    if not prefix:
        raise ValueError("the prefix is empty")
    return scan(log, Scan(prefix=prefix, **options))
