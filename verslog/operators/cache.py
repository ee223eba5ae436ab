"""Simulation of an adaptive replacement cache over access traces."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame


class AdaptiveCache:
    """Resident keys by how often they were asked for (once, again), ghosts of keys that were evicted from either, and the share
    ``p`` of the capacity meant for keys seen once, which moves towards the ghosts that are asked for."""

    def __init__(self, capacity: int):
        self.capacity, self.p = max(1, capacity), 0
        self.live = {"once": OrderedDict(), "again": OrderedDict()}
        self.ghosts = {"once": OrderedDict(), "again": OrderedDict()}

    def __len__(self) -> int:
        return sum(map(len, self.live.values()))

    def get(self, key):
        """The value of a resident key, which then counts as seen again, or None. Ghosts aren't touched."""
        home = next((part for part in self.live.values() if key in part), None)
        if home is None:
            return None
        value = home.pop(key)
        self.live["again"][key] = value
        return value

    def put(self, key, value) -> None:
        if self.get(key) is not None or any(key in part for part in self.live.values()):
            self.live["again"][key] = value
            return
        ghost = next((name for name, part in self.ghosts.items() if key in part), None)
        if ghost is None:
            self._make_room()
            self.live["once"][key] = value
            return
        own, other = len(self.ghosts[ghost]), len(self.ghosts["again" if ghost == "once" else "once"])
        step = max(1, other // own)
        self.p = min(self.capacity, self.p + step) if ghost == "once" else max(0, self.p - step)
        self._evict(ghost == "again")
        del self.ghosts[ghost][key]
        self.live["again"][key] = value

    def remove(self, key) -> None:
        """Drops a resident key; ghosts keep their history."""
        for part in self.live.values():
            part.pop(key, None)

    def _forget(self, name: str) -> None:
        if self.ghosts[name]:
            self.ghosts[name].popitem(last=False)

    def _make_room(self) -> None:
        """For a key without history."""
        known = len(self) + sum(map(len, self.ghosts.values()))
        if len(self) >= self.capacity:
            if len(self.live["once"]) < self.capacity:
                self._forget("once")
                self._evict(False)
            else:
                self._demote("once")
        elif known >= self.capacity:
            if known >= 2 * self.capacity:
                self._forget("again")
            self._forget("once")

    def _demote(self, name: str) -> None:
        key, _ = self.live[name].popitem(last=False)
        self.ghosts[name][key] = None

    def _evict(self, asked_again: bool) -> None:
        """Demotes the oldest key of the part that is beyond its share; of nothing if nothing is resident."""
        once = len(self.live["once"])
        beyond = once > self.p or (asked_again and once == self.p)
        if once and (beyond or not self.live["again"]):
            self._demote("once")
        elif self.live["again"]:
            self._demote("again")


def simulate(trace: DataFrame, capacity: int) -> DataFrame:
    """(cache_id, gets, hits, resident, p) from a trace (cache_id, step, key): a miss is followed by a put, as pages are read.

    A cache is one state that every step changes, so each cache is one task; a trace to be simulated at scale has many caches.
    The trace of a cache is processed in order of step. Null keys are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, hits = AdaptiveCache(capacity), 0
        for key in pdf.sort_values(["step", "key"])["key"]:
            if cache.get(key) is None:
                cache.put(key, True)
            else:
                hits += 1
        return pd.DataFrame({"cache_id": [pdf["cache_id"].iloc[0]], "gets": [len(pdf)], "hits": [hits], "resident": [len(cache)], "p": [cache.p]})

    kind = dict(trace.dtypes)["cache_id"]
    return trace.where("key is not null").select("cache_id", "step", "key").groupBy("cache_id").applyInPandas(run, f"cache_id {kind}, gets long, hits long, resident long, p long")
