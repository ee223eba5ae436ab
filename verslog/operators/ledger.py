"""Incremental processing: a ledger of work items with the states pending, leased and done.

A lease covers every item of a scope up to a position that was there when the lease was taken, and carries a fencing token
that grows within the scope. A run that ends well reports its lease done; a lease that ends otherwise, or whose time is up,
gives its items back. A report is rejected as stale when a lease with a higher token was taken before the report came.

``item_states`` resolves billions of items against their leases as one plan; ``WorkLedger`` is the small durable ledger from
which workers take units of work (files, sequence ranges) one by one.
"""

from __future__ import annotations

import json
import random
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verslog.commits import CommitLog, LostRace

#: Positions in a bucket: the most rows of a scope that one window has to order.
BUCKET = 1 << 16


def settle_leases(leases: DataFrame, reports: DataFrame, now: Column | None = None) -> DataFrame:
    """Leases (scope, token, upto, taken_at, expires_at) with a ``status``: done, open or lost.

    reports: (scope, token, reported_at, ok). Repeated reports of one lease count once, a lease listed twice is one lease.
    A report without ``ok`` true, or later than the taking of a higher token in its scope, doesn't finish a lease. An
    unfinished lease is open until ``expires_at`` (compared with ``now``; without ``now`` every unfinished lease is over).
    Leases with a null scope, token, upto or taken_at cover nothing and are dropped.
    """
    known = leases.select("scope", "token", "upto", "taken_at", "expires_at").dropna(subset=["scope", "token", "upto", "taken_at"])
    known = known.groupBy("scope", "token").agg(F.max("upto").alias("upto"), F.min("taken_at").alias("taken_at"), F.max("expires_at").alias("expires_at"))
    order = W.partitionBy("scope").orderBy("token")
    known = known.withColumn("next_taken", F.min("taken_at").over(order.rowsBetween(1, W.unboundedFollowing)))
    said = reports.where("ok").groupBy("scope", "token").agg(F.min("reported_at").alias("reported_at"))
    fresh = F.col("reported_at").isNotNull() & (F.col("next_taken").isNull() | (F.col("next_taken") >= F.col("reported_at")))
    still = F.coalesce(F.col("expires_at") > now, F.lit(False)) if now is not None else F.lit(False)
    return known.join(said, ["scope", "token"], "left").select(
        "scope", "token", "upto", "taken_at", "expires_at", F.when(fresh, "done").when(still, "open").otherwise("lost").alias("status")
    )


def item_states(items: DataFrame, leases: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Items (scope, position, seen_at) with ``state``: done if a done lease of the scope has upto >= position and
    taken_at >= seen_at, else leased if an open one has, else pending.

    Items must be distinct in (scope, position). A null scope, position or seen_at leaves an item pending.

    A lease covers a prefix of its scope, so only the latest taken_at among leases from a position on matters: a running
    maximum from the highest position down. Scopes are cut into buckets of positions, and what leases above a bucket give is
    carried in, so no task orders more than ``bucket`` positions however large a scope is. As items are distinct, those without a
    scope are cut into buckets like others and those without a position are one for each scope.
    """
    cell = F.floor(F.col("position") / bucket)
    steps = (
        leases.where(F.col("scope").isNotNull() & F.col("upto").isNotNull())
        .groupBy("scope", F.col("upto").alias("position"))
        .agg(F.max(F.when(F.col("status") == "done", F.col("taken_at"))).alias("done"), F.max(F.when(F.col("status") == "open", F.col("taken_at"))).alias("open"))
        .withColumn("cell", cell)
    )
    work = items.select("scope", "position", "seen_at").withColumn("cell", cell)
    tops = work.select("scope", "cell").where("scope is not null and cell is not null").distinct()
    down = W.partitionBy("scope").orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(None).cast("timestamp")
    kind = dict(steps.dtypes)["done"]
    carried = (
        steps.select("scope", "cell", "done", "open")
        .unionByName(tops.withColumns({"done": nothing.cast(kind), "open": nothing.cast(kind)}))
        .groupBy("scope", "cell")
        .agg(F.max("done").alias("done"), F.max("open").alias("open"))
        .select("scope", "cell", F.max("done").over(down).alias("done"), F.max("open").over(down).alias("open"))
        .where("done is not null or open is not null")
    )
    seen = dict(work.dtypes)["seen_at"]
    both = (
        work.select("scope", "cell", "position", "seen_at", nothing.cast(kind).alias("done"), nothing.cast(kind).alias("open"), F.lit(True).alias("item"))
        .unionByName(steps.select("scope", "cell", "position", nothing.cast(seen).alias("seen_at"), "done", "open", F.lit(False).alias("item")))
        .unionByName(carried.select("scope", "cell", ((F.col("cell") + 1) * bucket).cast(dict(work.dtypes)["position"]).alias("position"), nothing.cast(seen).alias("seen_at"), "done", "open", F.lit(False).alias("item")))
    )
    fall = W.partitionBy("scope", "cell").orderBy(F.col("position").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    has = lambda c: F.coalesce((F.max(c).over(fall) >= F.col("seen_at")) & F.col("scope").isNotNull() & F.col("position").isNotNull(), F.lit(False))
    return both.select("scope", "position", "seen_at", "item", F.when(has("done"), "done").when(has("open"), "leased").otherwise("pending").alias("state")).where("item").drop("item")


def next_items(states: DataFrame, upto: int, now: Column) -> DataFrame:
    """The pending items that a run starting now up to a position takes."""
    return states.where((F.col("state") == "pending") & (F.col("position") <= upto) & (F.col("seen_at") <= now)).drop("state")


class StaleLease(Exception):
    """A worker reported a unit that was leased to another worker since."""


@dataclass(frozen=True)
class Lease:
    unit: str
    token: int
    expires_at: float
    path: str


class WorkLedger:
    """A durable ledger of named units in a folder that driver processes share.

    Every change is one commit file ``N.json`` made by exclusive create, so of two processes that both go from N-1 only one
    wins and the other reads again. A checkpoint after every ``checkpoint_every`` commits bounds what a new process reads. The path
    of an output follows from unit and token: a retry under one lease overwrites what it left before, a worker whose lease is over
    can't touch the output of the one after it, and the commit that completes a unit publishes the path that counts (``outputs``).
    Time is passed in, never read, so that runs can be repeated.

    Units are coarse (files, ranges of numbers): each process keeps one small record for every unit. Rows by the billion go
    through ``item_states``.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint_every: int = 100):
        self.folder, self.checkpoint_every = folder.rstrip("/"), checkpoint_every
        self._log = CommitLog(spark, self.folder + "/commits")
        self._checkpoints = CommitLog(spark, self.folder + "/checkpoints")
        self._n, self._units = 0, {}
        for n in reversed(self._checkpoints.numbers()):
            if (text := self._checkpoints.read(n)) is not None:
                self._n, self._units = n, json.loads(text)
                break

    def _refresh(self) -> dict:
        while (text := self._log.read(self._n + 1)) is not None:
            for unit, change in json.loads(text).items():
                self._units.setdefault(unit, {"state": "pending", "token": 0, "expires_at": 0.0}).update(change)
            self._n += 1
            if self._n % self.checkpoint_every == 0:
                try:
                    self._checkpoints.create(self._n, json.dumps(self._units))
                except LostRace:
                    pass  # another process wrote the same
        return self._units

    def _commit(self, decide):
        """decide(units) gives (changes, result); taken again from the newest state until the commit file is ours."""
        pause = 0.01
        until = time.monotonic() + 2 * self._log.grace_s + 60
        while time.monotonic() < until:
            changes, result = decide(self._refresh())
            if not changes:
                return result
            try:
                self._log.create(self._n + 1, json.dumps(changes))
            except LostRace:
                time.sleep(pause * random.random())
                pause = min(2 * pause, 1.0)
                continue
            self._refresh()
            return result
        raise RuntimeError("the ledger is written by others all the time")

    def add(self, units: list[str]) -> int:
        """Adds units that aren't known yet; returns their number."""
        return self._commit(lambda have: ({u: {"state": "pending"} for u in units if u not in have}, len({u for u in units if u not in have})))

    def lease(self, limit: int, now: float, seconds: float) -> list[Lease]:
        """Takes up to ``limit`` units that are pending or whose lease is over, in order of their names."""

        def decide(have):
            free = [u for u, x in sorted(have.items()) if x["state"] == "pending" or (x["state"] == "leased" and x["expires_at"] <= now)][:limit]
            got = [Lease(u, have[u]["token"] + 1, now + seconds, f"{self.folder}/out/{u}/{have[u]['token'] + 1}") for u in free]
            return {g.unit: {"state": "leased", "token": g.token, "expires_at": g.expires_at} for g in got}, got

        return self._commit(decide)

    def complete(self, lease: Lease) -> None:
        """Reports a unit done. A repeated report is absorbed; one under an older token raises StaleLease."""

        def decide(have):
            x = have[lease.unit]
            if x["token"] != lease.token:
                raise StaleLease(f"{lease.unit}: token {lease.token}, now {x['token']}")
            return ({} if x["state"] == "done" else {lease.unit: {"state": "done", "path": lease.path}}), None

        self._commit(decide)

    def release(self, lease: Lease) -> None:
        """Gives a unit back after a failure; without effect under an older token."""
        self._commit(lambda have: ({lease.unit: {"state": "pending"}} if have[lease.unit]["token"] == lease.token and have[lease.unit]["state"] == "leased" else {}, None))

    def states(self) -> dict[str, str]:
        return {u: x["state"] for u, x in sorted(self._refresh().items())}

    def outputs(self) -> dict[str, str]:
        """The published output of every unit that is done; readers take no other path."""
        return {u: x["path"] for u, x in sorted(self._refresh().items()) if x["state"] == "done"}


def work(ledger: WorkLedger, process, clock, seconds: float, limit: int = 100) -> tuple[list[str], dict[str, Exception]]:
    """Leases up to ``limit`` units and processes them one by one: process(lease) writes to ``lease.path``, replacing what is there.
    Returns the units done and the errors of units given back. A unit that went to another worker meanwhile is in neither."""
    done, failed = [], {}
    for lease in ledger.lease(limit, clock(), seconds):
        try:
            process(lease)
            ledger.complete(lease)
            done.append(lease.unit)
        except StaleLease:
            continue
        except Exception as e:
            ledger.release(lease)
            failed[lease.unit] = e
    return done, failed
