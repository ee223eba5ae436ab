"""Filling windows of a fixed number of tokens with whole texts.

Texts are spread over shards of bounded size. In a shard, multiway differencing (Karmarkar and Karp) divides them into as
many windows as their tokens need at least: of all partial partitions the two with the largest spread are merged, the
fullest windows of the one with the emptiest of the other, which leaves near-equal windows. While a window exceeds the capacity the
number of windows rises; what the last rise passed over is then searched for a smaller number.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import importlib.util
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts of a shard: at most one part-filled window a shard is lost by sharding.
SHARD_ITEMS = 16_384


@cache
def encoding(folder: str, vocabulary: str):
    """The public tokenizer; its splitting pattern is that of the vocabulary's package."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("vocabularies", f"{folder}/__init__.py")
    package = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(package)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=package.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns but the text, and ``tokens``: of the whole text, 0 for null and empty."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest).withColumn("tokens", F.lit(0)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, vocabulary)
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in b.column(text)], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], n], names=[*rest, "tokens"])

    return df.select(*rest, text).mapInArrow(count, schema)


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two partial partitions as one: the windows that have to be shared are the emptiest of each, in opposing order."""
    (sums_a, item_a), (sums_b, item_b) = a, b
    both = len(sums_a) + len(sums_b) - k
    if both <= 0:
        sums, item = np.concatenate([sums_a, sums_b]), np.concatenate([item_a, item_b])
    else:
        la, lb = len(sums_a) - both, len(sums_b) - both
        parent[item_b[lb:][::-1]] = item_a[la:]
        sums = np.concatenate([sums_a[:la], sums_b[:lb], sums_a[la:] + sums_b[lb:][::-1]])
        item = np.concatenate([item_a[:la], item_b[:lb], item_a[la:]])
    down = np.argsort(-sums, kind="stable")
    return sums[down], item[down]


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Divides positive sizes among k windows by multiway differencing: window of each item, and the window sums.

    Of all partial partitions and single items the two with the largest spread are merged. Windows that a partial partition lacks
    count as empty, so one that isn't full yet takes in the next items one after the other: they are taken in at once. So are items
    that go to the emptiest window of a full one."""
    n = len(sizes)
    if not n:
        return np.full(0, -1), np.zeros(0, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    down, parent, i = sizes[order].astype(np.int64), np.arange(n), 0
    low = down.tolist()
    # (minus the spread, tie-break, window sums from the fullest down, one item of each); empty windows are left out.
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    count = 0

    def push(sums: np.ndarray, item: np.ndarray) -> None:
        nonlocal count
        heapq.heappush(heap, (int(sums[-1]) * (len(sums) == k) - int(sums[0]), count, sums, item))
        count += 1

    while True:
        if not heap or (i < n and low[i] > -heap[0][0]):
            sums, item, i = down[i : i + 1], order[i : i + 1], i + 1
        else:
            _, _, sums, item = heapq.heappop(heap)
        rival = -heap[0][0] if heap else -1
        if i == n and rival < 0:
            break
        if i == n or low[i] < rival:
            _, _, other, theirs = heapq.heappop(heap)
            push(*_merge((sums, item), (other, theirs), k, parent))
        elif len(sums) < k:
            far = i + int(np.searchsorted(-down[i : i + k - len(sums)], -rival, side="right"))
            sums, item = np.concatenate([sums, down[i:far]]), np.concatenate([item, order[i:far]])
            if sums[len(sums) - (far - i) - 1] < down[i]:
                again = np.argsort(-sums, kind="stable")
                sums, item = sums[again], item[again]
            i = far
            push(sums, item)
        else:  # windows from the emptiest up
            up, who = sums[::-1].tolist(), item[::-1].tolist()
            while True:
                size = low[i]
                total, at = up.pop(0) + size, who.pop(0)
                parent[order[i]] = at
                place = bisect.bisect_left(up, total)
                up.insert(place, total)
                who.insert(place, at)
                i += 1
                if i == n or low[i] < rival or up[-1] - up[0] < max(rival, low[i]):
                    break
            push(np.array(up[::-1], dtype=np.int64), np.array(who[::-1], dtype=np.int64))
    while (up := parent[parent]).tolist() != parent.tolist():
        parent = up
    window = np.full(n, -1)
    window[item] = np.arange(len(item))
    return window[parent], sums


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size from 1 to capacity, no window over capacity, with few windows.

    The count starts at the least that can do. While a window is over the capacity it rises in proportion to the fullest
    one, at least by one; then the last rise is halved until the count that fits is one above a count that doesn't. (Of 400 random
    sets of sizes none fitted into fewer windows than that.)"""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    k = max(-(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()), 1)
    below = k - 1
    while True:
        window, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            break
        below, k = k, min(max(k + 1, int(k * sums.max() / capacity)), len(sizes))
    while k - below > 1:
        mid = (k + below) // 2
        fewer, sums = differencing(sizes, mid)
        if sums.max() <= capacity:
            window, k = fewer, mid
        else:
            below = mid
    return window


def pack(df: DataFrame, item: str, tokens: str, capacities: dict[int, int] | list[tuple[int, int]], shards: int | None = None) -> DataFrame:
    """(container_id, item, piece, window, tokens): for each capacity, every item in exactly one window.

    An item larger than the capacity alone is divided: its full pieces fill windows of their own, the last piece is packed like
    an item. Items without tokens (null, 0 or less) take no room and are put into the first window of their shard. Items
    should have distinct ids, which spread them over the shards; repeats and nulls are packed too. An empty table and no
    capacities give no rows. ``capacities`` are pairs of a container id and its positive capacity; a pair listed twice is one, an id
    with several capacities gives the items once for each. What has one capacity is packed once, whatever the number of its ids.
    A window number is unique within its container id and capacity.
    """
    ids: dict[int, list[int]] = {}
    for i, c in sorted(set(capacities.items() if isinstance(capacities, dict) else capacities)):
        if c is None or c < 1:
            raise ValueError("capacities must be positive")
        ids.setdefault(c, []).append(i)
    if shards is None:
        shards = max(1, -(-df.count() // SHARD_ITEMS))
    kinds = dict(df.dtypes)
    schema = f"container_id int, {item} {kinds[item]}, piece int, window long, tokens long"
    if not capacities:
        return df.sparkSession.createDataFrame([], schema)
    rows = df.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("long"))
    # The sort makes a repeated task give the same windows whatever the order in which its rows arrive.
    rows = rows.withColumn("cap", F.explode(F.array(*[F.lit(c).cast("long") for c in sorted(ids)])))

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), ("item", "ascending")])
        n, cap = t.column("n").to_numpy(), t.column("cap")[0].as_py()
        full, rest = n // cap, n % cap
        packed = np.flatnonzero(rest > 0)
        window = fill(rest[packed], cap)
        used = int(window.max()) + 1 if len(window) else 0
        zero = np.flatnonzero(n == 0)
        cut = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(cut)) - np.repeat(np.cumsum(full) - full, full) if len(cut) else cut
        index = np.concatenate([packed, zero, cut])
        bins = np.concatenate([window, np.zeros(len(zero), dtype=np.int64), used + np.arange(len(cut))])
        placed = pa.table(
            {
                item: t.column("item").take(pa.array(index)),
                "piece": np.concatenate([full[packed], np.zeros(len(zero), dtype=np.int64), piece]).astype(np.int32),
                "window": t.column("shard")[0].as_py() * (1 << 32) + bins,
                "tokens": np.concatenate([rest[packed], np.zeros(len(zero), dtype=np.int64), np.full(len(cut), cap)]).astype(np.int64),
            }
        )
        return pa.concat_tables([placed.add_column(0, "container_id", pa.array(np.full(len(index), i, dtype=np.int32))) for i in ids[cap]])

    return rows.groupBy("cap", "shard").applyInArrow(group, schema)
