"""Queries p2 to p6 over the test tables, and the equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verslog.operators.changes import effective_changes, newest_first, seq_cuts
from verslog.operators.dedup import drop_repeats
from verslog.operators.diff import diff_copies
from verslog.operators.ledger import item_states, settle_leases
from verslog.operators.snapshots import snapshot_changes


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ok(df: DataFrame) -> DataFrame:
    return df.withColumn("ok", F.coalesce(F.lower(F.trim("outcome")) == "ok", F.lit(False)))


#: Days for which a backup run holds its lease if it doesn't report.
LEASE_DAYS = 10


def backup_leases(spark: SparkSession, sf: str, days_later: int) -> DataFrame:
    """Settled leases of all backup runs, so many days after the last run began. A run leases its store up to snap_seq at created_at
    for LEASE_DAYS, under the fencing token (created_at, manifest_id). One that ended ok reported when it wrote its manifest, at
    created_at; the others never report, and their lease runs out. A manifest listed twice is a repeated report."""
    runs = _ok(_read(spark, sf, "manifests")).withColumn("token", F.struct("created_at", "manifest_id"))
    span = lambda days: F.make_dt_interval(F.lit(days))
    leases = runs.select(F.col("store").alias("scope"), "token", F.col("snap_seq").alias("upto"), F.col("created_at").alias("taken_at"), (F.col("created_at") + span(LEASE_DAYS)).alias("expires_at"))
    reports = runs.where("ok").select(F.col("store").alias("scope"), "token", F.col("created_at").alias("reported_at"), "ok")
    last = runs.agg(F.max("created_at")).first()[0]
    return settle_leases(leases, reports, F.lit(last).cast(dict(runs.dtypes)["created_at"]) + span(days_later))


def backup_states(spark: SparkSession, sf: str, days_later: int) -> DataFrame:
    """Work items of all stores (records by store and seq, there since the first known arrival) with their ledger state."""
    records = _read(spark, sf, "wal_records").groupBy("store", "seq").agg(F.min("received_at").alias("seen_at"))
    return item_states(records.select(F.col("store").alias("scope"), F.col("seq").alias("position"), "seen_at"), backup_leases(spark, sf, days_later))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records that the next run of each store must take, once the last lease has run out."""
    return backup_states(spark, sf, LEASE_DAYS).where("state = 'pending'").select(F.col("scope").alias("store"), F.col("position").alias("seq"))


def p2_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each store by ledger state, once the last lease has run out."""
    return backup_states(spark, sf, LEASE_DAYS).groupBy(F.col("scope").alias("store"), "state").agg(F.count("*").alias("items"))


def p2_leases(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each store by ledger state at the moment the last run began, while runs of the days before still hold theirs."""
    return backup_states(spark, sf, 0).groupBy(F.col("scope").alias("store"), "state").agg(F.count("*").alias("items"))


def p2_lease_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Leases of each store by their status at that moment: done, open or lost."""
    return backup_leases(spark, sf, 0).groupBy(F.col("scope").alias("store"), "status").agg(F.count("*").alias("leases"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """File entries missing on either side or differing in size or sha256."""
    return diff_copies(
        _read(spark, sf, "files_primary"), _read(spark, sf, "files_replica"), ["manifest_id", "name"], ["size", "sha256"], ("primary", "replica"), {"sha256": F.lower}
    )


def p3_copies(spark: SparkSession, sf: str) -> DataFrame:
    """As p3_found, with the surplus copies of entries that both sides have."""
    return diff_copies(
        _read(spark, sf, "files_primary"), _read(spark, sf, "files_replica"), ["manifest_id", "name"], ["size", "sha256"], ("primary", "replica"), {"sha256": F.lower}, extra_copies=True
    )


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Fields, the name among them, in which the entries of a manifest differ after entries that aren't listed alike on both sides were
    paired at least cost: renamed files are told from lost ones. Each manifest has several such entries."""
    return diff_copies(_read(spark, sf, "files_primary"), _read(spark, sf, "files_replica"), ["manifest_id"], ["sha256", "size", "name"], ("primary", "replica"), {"sha256": F.lower})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries to drop so that one copy of each message remains."""
    return drop_repeats(_read(spark, sf, "wal_records"), "store", "seq", ["txn_id", "key"], "delivery_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Live keys of every store after all changes of the feed."""
    feed = _read(spark, sf, "wal_log")
    return newest_first(effective_changes(feed), ["store", "key"], cuts=seq_cuts(feed))


def p5_images(spark: SparkSession, sf: str) -> DataFrame:
    """Live keys of every store with their value."""
    feed = _read(spark, sf, "wal_log")
    return newest_first(effective_changes(feed), ["store", "key"], keep=["value"], cuts=seq_cuts(feed))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files added, removed or changed between consecutive successful manifests of a store."""
    runs = _ok(_read(spark, sf, "manifests")).where("ok")
    runs = runs.select(F.col("store").alias("scope"), F.col("manifest_id").alias("snapshot"), F.col("created_at").alias("taken_at"), "files")
    found = snapshot_changes(runs, "files", lambda f: f["name"], lambda f: F.lower(f["sha256"]))
    return found.select(F.col("snapshot").alias("manifest_id"), F.col("key").alias("name"), "change")


QUERIES = {f.__name__: f for f in (p2_found, p2_state_counts, p2_leases, p2_lease_counts, p3_found, p3_copies, p3_pairs, p4_found, p5_found, p5_images, p6_found)}

_P2 = """WITH r AS (SELECT store, seq, min(received_at) AS seen FROM wal_records GROUP BY store, seq),
m AS (SELECT DISTINCT store, snap_seq, created_at FROM manifests WHERE lower(trim(outcome)) = 'ok'),
s AS (SELECT r.store, r.seq, EXISTS (SELECT 1 FROM m WHERE m.store = r.store AND m.snap_seq >= r.seq AND m.created_at >= r.seen) AS done FROM r)
"""
_P3 = """WITH a AS (SELECT manifest_id, name, size, lower(sha256) AS sha, count(*) AS n FROM files_primary GROUP BY ALL),
b AS (SELECT manifest_id, name, size, lower(sha256) AS sha, count(*) AS n FROM files_replica GROUP BY ALL),
j AS (SELECT coalesce(a.manifest_id, b.manifest_id) AS manifest_id, coalesce(a.name, b.name) AS name, a.n AS an, b.n AS bn, a.size AS asize, b.size AS bsize, a.sha AS asha, b.sha AS bsha
 FROM a FULL JOIN b ON a.manifest_id IS NOT DISTINCT FROM b.manifest_id AND a.name IS NOT DISTINCT FROM b.name),
d AS (SELECT manifest_id, name, 'missing_in_replica' AS difference FROM j WHERE bn IS NULL
 UNION ALL SELECT manifest_id, name, 'missing_in_primary' FROM j WHERE an IS NULL
 UNION ALL SELECT manifest_id, name, 'size' FROM j WHERE an IS NOT NULL AND bn IS NOT NULL AND asize IS DISTINCT FROM bsize
 UNION ALL SELECT manifest_id, name, 'sha256' FROM j WHERE an IS NOT NULL AND bn IS NOT NULL AND asha IS DISTINCT FROM bsha)
"""
_P5 = """WITH c AS (SELECT DISTINCT store, txn_id FROM wal_log WHERE kind = 3),
e AS (SELECT l.store, l.key, l.seq, l.value, coalesce(l.kind = 1, false) OR coalesce(l.tombstone, false) AS deleted
 FROM wal_log l LEFT JOIN c ON c.store = l.store AND c.txn_id = l.txn_id
 WHERE l.key IS NOT NULL AND (l.kind IS NULL OR l.kind IN (0, 1)) AND (coalesce(l.txn_id, 0) = 0 OR c.txn_id IS NOT NULL)),
n AS (SELECT *, row_number() OVER (PARTITION BY store, key ORDER BY seq DESC, deleted DESC, value DESC NULLS LAST) AS r FROM e)
"""

ORACLE = {
    "p2_found": _P2 + "SELECT store, seq FROM s WHERE NOT done",
    "p2_state_counts": _P2 + "SELECT store, CASE WHEN done THEN 'done' ELSE 'pending' END AS state, count(*) AS items FROM s GROUP BY 1, 2",
    "p2_leases": f"""WITH r AS (SELECT store, seq, min(received_at) AS seen FROM wal_records GROUP BY store, seq),
m AS (SELECT store, created_at, snap_seq, coalesce(lower(trim(outcome)) = 'ok', false) AS ok, created_at + INTERVAL {LEASE_DAYS} DAY > max(created_at) OVER () AS runs FROM manifests),
s AS (SELECT r.store, CASE WHEN EXISTS (SELECT 1 FROM m WHERE ok AND m.store = r.store AND m.snap_seq >= r.seq AND m.created_at >= r.seen) THEN 'done'
 WHEN EXISTS (SELECT 1 FROM m WHERE NOT ok AND runs AND m.store = r.store AND m.snap_seq >= r.seq AND m.created_at >= r.seen) THEN 'leased' ELSE 'pending' END AS state FROM r)
SELECT store, state, count(*) AS items FROM s GROUP BY 1, 2""",
    "p2_lease_counts": f"""WITH m AS (SELECT store, created_at, manifest_id, bool_or(coalesce(lower(trim(outcome)) = 'ok', false)) AS ok, any_value(created_at) + INTERVAL {LEASE_DAYS} DAY > (SELECT max(created_at) FROM manifests) AS runs
 FROM manifests WHERE snap_seq IS NOT NULL AND store IS NOT NULL AND created_at IS NOT NULL GROUP BY store, created_at, manifest_id)
SELECT store, CASE WHEN ok THEN 'done' WHEN runs THEN 'open' ELSE 'lost' END AS status, count(*) AS leases FROM m GROUP BY 1, 2""",
    "p3_found": _P3 + "SELECT * FROM d",
    # All assignments of the smaller side's leftovers to the larger side's, of which the least by (differences, sha256, size, name) counts.
    "p3_pairs": """WITH RECURSIVE v AS (SELECT manifest_id, name, size, lower(sha256) AS sha, sum(s) AS d FROM (SELECT *, 1 AS s FROM files_primary UNION ALL SELECT *, -1 FROM files_replica) GROUP BY ALL),
x AS (SELECT manifest_id, name, size, sha, d > 0 AS l, unnest(range(abs(d)::BIGINT)) AS k FROM v WHERE d <> 0),
t AS (SELECT manifest_id, sum(l) AS l, sum(r) AS r FROM (SELECT manifest_id, 1 AS l, 0 AS r FROM files_primary UNION ALL SELECT manifest_id, 0, 1 FROM files_replica) GROUP BY 1),
n AS (SELECT manifest_id, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr FROM x GROUP BY 1),
y AS (SELECT x.*, x.l = (nl <= nr) AS small, row_number() OVER (PARTITION BY x.manifest_id, x.l ORDER BY name, size, sha, k) AS i FROM x JOIN n ON x.manifest_id IS NOT DISTINCT FROM n.manifest_id),
p AS (SELECT manifest_id, least(nl, nr) AS n, 0::BIGINT AS i, 0::HUGEINT AS used, 0 AS c, 0 AS s, 0 AS z, 0 AS m FROM n WHERE nl > 0 AND nr > 0
 UNION ALL SELECT p.manifest_id, p.n, p.i + 1, p.used + (2::HUGEINT ** b.i)::HUGEINT, p.c + (a.sha IS DISTINCT FROM b.sha)::INT + (a.size IS DISTINCT FROM b.size)::INT + (a.name IS DISTINCT FROM b.name)::INT,
 p.s + (a.sha IS DISTINCT FROM b.sha)::INT, p.z + (a.size IS DISTINCT FROM b.size)::INT, p.m + (a.name IS DISTINCT FROM b.name)::INT
 FROM p JOIN y a ON a.manifest_id IS NOT DISTINCT FROM p.manifest_id AND a.small AND a.i = p.i + 1 JOIN y b ON b.manifest_id IS NOT DISTINCT FROM p.manifest_id AND NOT b.small AND (p.used // (2::HUGEINT ** b.i)::HUGEINT) % 2 = 0),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY c, s, z, m) AS r FROM p WHERE i = n) WHERE r = 1)
SELECT manifest_id, 'missing_in_replica' AS difference FROM t WHERE r = 0 UNION ALL SELECT manifest_id, 'missing_in_primary' FROM t WHERE l = 0
UNION ALL SELECT manifest_id, 'sha256' FROM q WHERE s > 0 UNION ALL SELECT manifest_id, 'size' FROM q WHERE z > 0 UNION ALL SELECT manifest_id, 'name' FROM q WHERE m > 0""",
    "p3_copies": _P3
    + """SELECT * FROM d UNION ALL SELECT manifest_id, name, 'extra_in_primary' FROM j WHERE an > bn
 UNION ALL SELECT manifest_id, name, 'extra_in_replica' FROM j WHERE bn > an""",
    "p4_found": """SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY store, seq, txn_id, key ORDER BY delivery_id) AS r
 FROM wal_records) WHERE r > 1""",
    "p5_found": _P5 + "SELECT store, key, seq FROM n WHERE r = 1 AND NOT deleted",
    "p5_images": _P5 + "SELECT store, key, seq, value FROM n WHERE r = 1 AND NOT deleted",
    "p6_found": """WITH m AS (SELECT manifest_id, min(store) AS store, min(created_at) AS taken FROM manifests WHERE lower(trim(outcome)) = 'ok' AND files IS NOT NULL GROUP BY 1),
o AS (SELECT manifest_id, lag(manifest_id) OVER (PARTITION BY store ORDER BY taken, manifest_id) AS old FROM m),
f AS (SELECT DISTINCT manifest_id, x.name AS name, lower(x.sha256) AS sha
 FROM (SELECT manifest_id, unnest(files) AS x FROM manifests WHERE lower(trim(outcome)) = 'ok')),
a AS (SELECT o.manifest_id, f.name, f.sha FROM o JOIN f ON f.manifest_id = o.manifest_id WHERE o.old IS NOT NULL),
b AS (SELECT o.manifest_id, f.name, f.sha FROM o JOIN f ON f.manifest_id = o.old)
SELECT coalesce(a.manifest_id, b.manifest_id) AS manifest_id, coalesce(a.name, b.name) AS name,
 CASE WHEN b.manifest_id IS NULL THEN 'added' WHEN a.manifest_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.manifest_id = b.manifest_id AND a.name = b.name
WHERE a.manifest_id IS NULL OR b.manifest_id IS NULL OR a.sha IS DISTINCT FROM b.sha""",
}
