"""Test passages in training text: documents that share a long run of characters with a test item.

Texts are compared as letters and numbers only. A shared run of R characters holds at least one of the item's aligned chunks
of R/2 characters, so the distinct chunks are the patterns of a Wu-Manber search. The windows of R characters around a hit are then
looked up by their hash among the items' distinct windows and compared character by character. A window or chunk that many items
share is one entry, and a text's hits are taken by distinct windows, so what is common to many items or repeated in a text costs no
pairs. The search is exact for every run of R or more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 40
#: Characters in a block of the shift table.
BLOCK = 3
#: Normalised characters of items searched for in one pass; what a pass broadcasts is at most some 40 bytes for each.
PASS_CHARS = 4_000_000
#: Characters of documents that are scanned at once, and of one lane of the scan.
SCAN_CHARS, LANE = 4_000_000, 512
_PAD = 64
_DROP = regex.compile(r"[^\p{L}\p{N}]+")


def normalise(text: str | None) -> str:
    """NFC, lower case, letters and numbers only; a null text is empty."""
    return _DROP.sub("", unicodedata.normalize("NFC", text).lower()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _joined(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All characters with a gap character after each text, padded at both ends; where each text starts."""
    codes = _codes("\n".join(texts) + "\n")
    codes[codes == 10] = gap
    ends = np.flatnonzero(codes == gap)
    return np.concatenate([np.full(_PAD, gap), codes, np.full(_PAD, gap)]), np.concatenate([[0], ends[:-1] + 1]) + _PAD


class Patterns:
    """Shift table, suffix buckets, chunks and windows of one pass's items, whose texts are distinct."""

    def __init__(self, ids: list[list[int]], texts: list[str], run: int = RUN):
        self.m, self.run, self.ids = run // 2, run, ids
        self.text, start = _joined(texts, -2)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        long = np.flatnonzero(sizes >= run)
        # Distinct windows in order of their hash; ``owners`` holds the items of window w from first[w] to first[w + 1].
        at, owner = _spread(long, start[long], start[long] + sizes[long] - run + 1)[::-1] if len(long) else (long, long)
        hashes = self.window_hashes(self.text, at)
        order = np.lexsort((owner, hashes))
        at, owner, hashes = at[order], owner[order], hashes[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | self._unlike(at)) if len(at) else np.zeros(0, dtype=bool)
        self.window, self.hash, self.owners = at[new], hashes[new], owner
        self.first = np.append(np.flatnonzero(new), len(at))
        # Distinct aligned chunks in order of suffix block, then prefix block, then text.
        at = np.concatenate([np.arange(start[i], start[i] + sizes[i] - self.m + 1, self.m) for i in long]) if len(long) else long
        self.mask = (1 << max(12, int(8 * len(at) * self.m).bit_length())) - 1
        self.shift = np.full(self.mask + 1, self.m - BLOCK + 1, dtype=np.uint8)
        for end in range(BLOCK, self.m + 1):
            np.minimum.at(self.shift, self.block(self.text, at + end), self.m - end)
        suffix, prefix = self.block(self.text, at + self.m), self.block(self.text, at + BLOCK)
        whole = self.text[at[:, None] + np.arange(self.m)] if len(at) else np.zeros((0, self.m), dtype=np.int64)
        order = np.lexsort([*whole.T[::-1], prefix, suffix])
        at, whole, bucket = at[order], whole[order], (suffix * (self.mask + 1) + prefix)[order]
        new = np.append(True, (whole[1:] != whole[:-1]).any(axis=1)) if len(order) else np.zeros(0, dtype=bool)
        self.chunk, self.bucket = at[new], bucket[new]

    def _unlike(self, at: np.ndarray) -> np.ndarray:
        """Whether each window's text differs from the one before it (asked for neighbours with equal hash)."""
        out = np.zeros(max(0, len(at) - 1), dtype=bool)
        for i in range(0, len(out), 1 << 15):
            a, b = at[i : i + (1 << 15) + 1][:-1], at[i + 1 : i + (1 << 15) + 1]
            out[i : i + len(a)] = (self.text[a[:, None] + np.arange(self.run)] != self.text[b[:, None] + np.arange(self.run)]).any(axis=1)
        return out

    def window_hashes(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the run that begins at each position."""
        h = np.zeros(len(at), dtype=np.uint64)
        for i in range(self.run):
            h = (h ^ text[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def block(self, text: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block that ends before each position."""
        h = text[end - 3] * 1_000_003 + text[end - 2] * 8_191 + text[end - 1] * 131
        return (h ^ (h >> 15)) & self.mask

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Window starts whose last block ends a chunk: the shifting scan, all lanes of the text in step."""
        last = len(text) - _PAD - self.m
        at = np.arange(_PAD, last + 1, LANE)
        stop = np.minimum(at + LANE, last + 1)
        found = []
        while len(at):
            step = self.shift[self.block(text, at + self.m)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def hits(self, text: np.ndarray) -> np.ndarray:
        """Positions of the chunks in the text: candidates whose characters are those of a chunk of their bucket."""
        where = self.candidates(text)
        key = self.block(text, where + self.m) * (self.mask + 1) + self.block(text, where + BLOCK)
        low, high = np.searchsorted(self.bucket, key), np.searchsorted(self.bucket, key, side="right")
        far, out = np.arange(self.m), [where[:0]]
        while len(where):  # the chunks of a bucket, which are distinct, one after the other
            go = low < high
            where, low, high = where[go], low[go], high[go]
            same = np.zeros(len(where), dtype=bool)
            for i in range(0, len(where), 1 << 15):
                part = slice(i, i + (1 << 15))
                same[part] = (text[where[part, None] + far] == self.text[self.chunk[low[part]][:, None] + far]).all(axis=1)
            out.append(where[same])
            where, low, high = where[~same], low[~same] + 1, high[~same]
        return np.concatenate(out)

    def runs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every run in the text that is an item's and holds a chunk."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.window):
            return none, none
        at = self.hits(text)
        # The windows around the hits, each once; one that reaches over the end of a text meets a gap character.
        at = np.unique((at[:, None] - np.arange(self.run - self.m + 1)).ravel())
        at = at[(at >= 0) & (at + self.run <= len(text))]
        hashes = self.window_hashes(text, at)
        low, high = np.searchsorted(self.hash, hashes), np.searchsorted(self.hash, hashes, side="right")
        far, found = np.arange(self.run), [(none, none)]
        while len(at):  # windows of equal hash, as good as always one; among several a text may be there more than once
            go = low < high
            at, low, high = at[go], low[go], high[go]
            same = np.zeros(len(at), dtype=bool)
            for i in range(0, len(at), 1 << 15):
                part = slice(i, i + (1 << 15))
                same[part] = (text[at[part, None] + far] == self.text[self.window[low[part]][:, None] + far]).all(axis=1)
            found.append((at[same], low[same]))
            low = low + 1
        return tuple(np.concatenate(x) for x in zip(*found))

    def search(self, ids: list, texts: list[str]) -> set[tuple]:
        """Distinct (item id, document id) of some documents."""
        text, start = _joined(texts, -1)
        pos, window = self.runs(text)
        doc = np.searchsorted(start, pos, side="right") - 1
        both = np.unique(np.column_stack([doc, window]), axis=0)  # a window once a document, however often it comes
        out = set()
        for i in range(0, len(both), 1 << 15):
            doc, window = both[i : i + (1 << 15)].T
            d, entry = _spread(doc, self.first[window], self.first[window + 1])
            for d, item in np.unique(np.column_stack([d, self.owners[entry]]), axis=0):
                out.update((x, ids[d]) for x in self.ids[item])
        return out


def _spread(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value with every index of its range."""
    n = high - low
    base = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else low
    return np.repeat(value, n), base + np.arange(int(n.sum()))


def _passes(items: DataFrame, item_id: str, text: str, run: int) -> Iterator[Patterns]:
    """Patterns of as many items as a pass holds; items of a pass with equal text are searched for once."""
    ids, size = {}, 0
    for r in items.select(item_id, text).where(F.col(item_id).isNotNull()).toLocalIterator():
        t = normalise(r[1])
        if len(t) < run:
            continue
        size += 0 if t in ids else len(t)
        ids.setdefault(t, set()).add(r[0])
        if size >= PASS_CHARS:
            yield Patterns([sorted(x) for x in ids.values()], list(ids), run)
            ids, size = {}, 0
    if ids:
        yield Patterns([sorted(x) for x in ids.values()], list(ids), run)


def find_leaks(documents: DataFrame, items: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """Distinct pairs (item, document) whose normalised texts share at least ``run`` characters in a row; run is even.

    Null and empty texts and items of fewer characters share nothing; pairs with a null id are left out. A repeated id stands for
    all of its texts and gives each pair once, for which the pairs, and only they, are shuffled. Whole texts are searched.
    Items are taken in passes of PASS_CHARS characters, so what is broadcast has a bound; documents are read once per pass.
    """
    if run % 2 or run > 2 * _PAD or run // 2 < BLOCK:
        raise ValueError("run must be even and between 6 and 128")
    spark = documents.sparkSession
    schema = f"{item_id} long, {doc_id} long"
    docs = documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and length(t) > 0")
    out = spark.createDataFrame([], schema)
    for patterns in _passes(items, item_id, text, run):
        sent = spark.sparkContext.broadcast(patterns)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            target = pa.schema([(item_id, pa.int64()), (doc_id, pa.int64())])
            for b in batches:
                ids, texts, size, found = [], [], 0, set()
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    ids.append(d)
                    texts.append(normalise(t.as_py()))
                    size += len(texts[-1]) + 1
                    if size >= SCAN_CHARS:
                        found |= sent.value.search(ids, texts)
                        ids, texts, size = [], [], 0
                if ids:
                    found |= sent.value.search(ids, texts)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(found))], schema=target)

        out = out.unionByName(docs.mapInArrow(scan, schema))
    return out.distinct()
