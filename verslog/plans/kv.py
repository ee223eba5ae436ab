"""Queries of the versioned log over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verslog.functions import keys as K
from verslog.operators import bloom, cache, families, index, merge, order, resolve, scan, ttl, txn
from verslog.session import scratch
from verslog.sources import log as L
from verslog.sources.backup import verify
from verslog.streaming import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Times are passed to every operator; the log covers January 2024.
NOW_NS = 1_705_708_800_000_000_000  # 2024-01-20 00:00:00 UTC
#: Bytes accounted before a flush, and of a page.
FLUSH_BYTES, PAGE_BYTES = 64 << 10, 4096
RING = 65_536

_LOG = """WITH log AS (SELECT event_id + 1 AS seq, concat('user:', lpad(CAST(user_id AS varchar), 6, '0'), ':', CAST(event_id % 8 AS varchar)) AS key,
 CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '|', props) END AS value, event_type = 'error' AS tombstone, ts,
 CASE WHEN event_id % 10 < 4 THEN event_id // 10 + 1 ELSE 0 END AS txn_id, event_type, props FROM events),
n AS (SELECT max(seq) AS n FROM log),
lv AS (SELECT log.*, CASE WHEN seq * 10 <= n * 4 THEN 3 WHEN seq * 10 <= n * 7 THEN 2 WHEN seq * 10 <= n * 9 THEN 1 ELSE 0 END AS level FROM log, n)"""


def _newest(source: str, name: str, keys: str = "key", where: str = "true") -> str:
    return f",\n{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) AS r FROM {source} WHERE {where}) WHERE r = 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    log = L.event_log(spark, sf)
    return log, L.last_seq(log)


# --- reads -----------------------------------------------------------------------------------------------------------


@query(_LOG + _newest("log", "c") + "SELECT key, value, seq FROM c WHERE NOT tombstone")
def latest(spark, sf):
    """Newest live version of every key."""
    return resolve.live(L.event_log(spark, sf)).select("key", "value", "seq")


@query("SELECT hex(key) AS key, hex(value) AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, tombstone DESC, value DESC NULLS LAST) AS r FROM entries) WHERE r = 1 AND NOT coalesce(tombstone, false)")
def latest_entries(spark, sf):
    """The same over stored versions with binary keys, control bytes and repeated rows included."""
    return resolve.live(L.entry_log(spark, sf)).select(F.hex("key").alias("key"), F.hex("value").alias("value"), "seq")


@query(_LOG + _newest("log, n", "c", where="seq * 2 <= n") + "SELECT key, value, seq FROM c WHERE NOT tombstone")
def snapshot_scan(spark, sf):
    log, last = _log(spark, sf)
    return resolve.live(log, at=last // 2).select("key", "value", "seq")


def _wanted(spark, sf) -> DataFrame:
    """A key per customer, of which the log knows some."""
    return L.table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(":"), (F.col("c_custkey") % 8).cast("string")).alias("key"))


_WANTED = ",\nw AS (SELECT concat('user:', lpad(CAST(c_custkey AS varchar), 6, '0'), ':', CAST(c_custkey % 8 AS varchar)) AS key FROM customer)"


@query(_LOG + _newest("log", "c") + _WANTED + """SELECT w.key, CASE WHEN c.seq IS NULL THEN 'NOT_FOUND' WHEN c.tombstone THEN 'DELETED' ELSE 'FOUND' END AS status,
 CASE WHEN NOT c.tombstone THEN c.value END AS value, c.seq FROM w LEFT JOIN c ON c.key = w.key""")
def point_get_status(spark, sf):
    return resolve.get_status(L.event_log(spark, sf), _wanted(spark, sf))


@query(_LOG + _newest("log", "c") + _WANTED + "SELECT w.key, c.value, c.seq FROM w JOIN c ON c.key = w.key WHERE NOT c.tombstone")
def multi_get(spark, sf):
    return resolve.get_status(L.event_log(spark, sf), _wanted(spark, sf)).where("status = 'FOUND'").select("key", "value", "seq")


@query(_LOG + _WANTED + "SELECT w.key, coalesce(max(log.seq) FILTER (log.seq * 10 <= n * 6), 0) AS seq FROM w CROSS JOIN n LEFT JOIN log ON log.key = w.key GROUP BY w.key")
def seq_at(spark, sf):
    log, last = _log(spark, sf)
    return resolve.seq_at(log, _wanted(spark, sf), last * 6 // 10)


@query(_LOG + """,
p AS (SELECT o_orderkey AS probe, concat('user:', lpad(CAST(o_custkey % 150 AS varchar), 6, '0'), ':', CAST(o_orderkey % 8 AS varchar)) AS key, 1 + (o_orderkey * 7919) % n AS at_seq FROM orders, n)
SELECT p.probe, p.key, p.at_seq, log.seq AS found_seq, log.tombstone AS found_tombstone, log.value AS found_value FROM p ASOF LEFT JOIN log ON p.key = log.key AND p.at_seq >= log.seq""")
def asof_multi_get(spark, sf):
    """For every order a key and a point in the log: what a reader saw then."""
    log, last = _log(spark, sf)
    key = F.concat(F.lit("user:"), F.lpad((F.col("o_custkey") % 150).cast("string"), 6, "0"), F.lit(":"), (F.col("o_orderkey") % 8).cast("string"))
    probes = L.table(spark, sf, "orders").select(key.alias("key"), (F.lit(1) + F.col("o_orderkey") * 7919 % last).alias("at"), F.col("o_orderkey").alias("probe"))
    return resolve.asof(log, probes).withColumnRenamed("at", "at_seq")


@query(_LOG + "SELECT key, value, seq, tombstone FROM lv WHERE level = 0")
def memtable_dump(spark, sf):
    """All versions of the newest tier, in key order, newest version first."""
    log, last = _log(spark, sf)
    return L.split_tiers(log, last)[0].select("key", "value", "seq", "tombstone").orderBy("key", F.col("seq").desc())


@query(_LOG + "SELECT key, seq, lag(seq) OVER w AS prev_seq, lead(seq) OVER w AS next_seq FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)")
def version_history(spark, sf):
    return resolve.history(L.event_log(spark, sf))


# --- scans -----------------------------------------------------------------------------------------------------------

_RANGE = "key >= 'user:000010' AND key < 'user:000060'"


@query(_LOG + _newest("log", "c", where=_RANGE) + "SELECT key, value, seq, tombstone FROM c WHERE NOT tombstone")
def range_scan(spark, sf):
    return scan.scan(L.event_log(spark, sf), scan.Scan("user:000010", "user:000060"))


@query(_LOG + _newest("log, n", "c", where=_RANGE + " AND seq * 2 <= n") + "SELECT key, value, seq, tombstone FROM c WHERE NOT tombstone")
def range_scan_snapshot(spark, sf):
    log, last = _log(spark, sf)
    return scan.scan(log, scan.Scan("user:000010", "user:000060", snapshot=last // 2))


@query(_LOG + _newest("log", "c", where="starts_with(key, 'user:00000')") + "SELECT key, value, seq, tombstone FROM c WHERE NOT tombstone")
def prefix_scan(spark, sf):
    return scan.prefix_scan(L.event_log(spark, sf), "user:00000")


@query("SELECT hex(key) AS key, seq, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, tombstone DESC) AS r FROM entries) WHERE r = 1 AND NOT coalesce(tombstone, false) AND starts_with(hex(key), '006366')")
def prefix_scan_binary(spark, sf):
    """Keys of all families, by a binary prefix with control bytes."""
    return scan.prefix_scan(L.entry_log(spark, sf), b"\x00cf").select(F.hex("key").alias("key"), "seq", "tombstone")


@query("""SELECT p AS prefix, CASE WHEN length(s) > 0 THEN concat(substr(s, 1, length(s) - 2), printf('%02X', CAST(concat('0x', right(s, 2)) AS integer) + 1)) END AS bound
FROM (SELECT p, regexp_replace(p, '(FF)+$', '') AS s FROM (SELECT DISTINCT substr(hex(key), 1, 6) AS p FROM entries WHERE key IS NOT NULL))""")
def prefix_upper_bound(spark, sf):
    """The least key above each three-byte prefix of the stored keys."""
    heads = L.entry_log(spark, sf).where("key is not null").select(F.substring("key", 1, 3).alias("p")).distinct()
    return heads.select(F.hex("p").alias("prefix"), F.hex(K.prefix_bound_column(F.col("p"))).alias("bound"))


@query(_LOG + _newest("log", "c") + "SELECT key, value, seq, tombstone FROM c WHERE NOT tombstone ORDER BY key DESC LIMIT 25")
def reverse_scan_topk(spark, sf):
    return scan.scan(L.event_log(spark, sf), scan.Scan(reverse=True, limit=25))


@query(_LOG + _newest("log", "c") + "SELECT key, value, seq, tombstone FROM c")
def scan_with_tombstones(spark, sf):
    return scan.scan(L.event_log(spark, sf), scan.Scan(tombstones=True))


@query(_LOG + _newest("log", "c") + "SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM c WHERE NOT tombstone")
def cursor_neighbours(spark, sf):
    """Where a cursor on each live key moves to."""
    return scan.neighbours(resolve.live(L.event_log(spark, sf)))


@query("""SELECT DISTINCT hex(key) AS key FROM (SELECT key FROM entries UNION ALL SELECT key FROM incoming_entries)
WHERE starts_with(hex(key), '0074746C00') OR starts_with(hex(key), '0069647800') OR hex(key) = '0063665F6D657461'""")
def internal_key_filter(spark, sf):
    """System keys among stored and new keys."""
    both = L.entry_log(spark, sf).select("key").unionByName(L.table(spark, sf, "incoming_entries").select("key"))
    return both.where(K.is_system_key(F.col("key"))).select(F.hex("key").alias("key")).distinct()


# --- tiers and compaction --------------------------------------------------------------------------------------------


@query(_LOG + _newest("lv", "c") + "SELECT key, value, seq, level FROM c WHERE NOT tombstone")
def tier_merge(spark, sf):
    """Newest live version over four tiers, with the tier that holds it."""
    log, last = _log(spark, sf)
    return merge.merge_newest(L.split_tiers(log, last)).where("not tombstone").select("key", "value", "seq", F.col("level").cast("int").alias("level"))


@query(_LOG + _newest("lv", "c", where="level = 1") + "SELECT key, value, seq, tombstone FROM c")
def kway_merge_l0(spark, sf):
    """Four files of the first tier become one run."""
    log, last = _log(spark, sf)
    tier = L.split_tiers(log, last)[1]
    return merge.merge_newest([tier.where(F.col("seq") % 4 == i) for i in range(4)]).select("key", "value", "seq", "tombstone")


@query(_LOG + _newest("lv", "c", where="level IN (1, 2)") + "SELECT key, value, seq, tombstone FROM c")
def compact_l0_l1(spark, sf):
    """Compaction above the bottom keeps tombstones."""
    log, last = _log(spark, sf)
    tiers = L.split_tiers(log, last)
    return merge.compact(tiers[1:3], [], bottom=False)


@query(_LOG + _newest("lv", "c", where="level IN (2, 3)") + """, s AS (SELECT sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) + 20) AS b FROM lv WHERE level = 2)
SELECT key, value, seq, tombstone FROM c, s WHERE b >= 16384 AND NOT tombstone
UNION ALL SELECT key, value, seq, tombstone FROM lv, s WHERE b < 16384 AND level IN (2, 3)""")
def compact_l1_l2(spark, sf):
    """Once the middle tier is large enough it moves to the bottom, where tombstones go."""
    log, last = _log(spark, sf)
    _, _, middle, bottom = L.split_tiers(log, last)
    size = middle.agg(F.coalesce(F.sum(merge.entry_bytes(merge.TIER_OVERHEAD)), F.lit(0))).first()[0]
    if size < 16384:
        return merge.union_tiers([middle, bottom]).select("key", "value", "seq", "tombstone")
    return merge.compact([middle, bottom], [], bottom=True)


_PINS = [25, 60]


def _pins(last: int) -> list[int]:
    return [last * p // 100 for p in _PINS]


_RETAINED = """,
k AS (SELECT DISTINCT key, max(seq) OVER (PARTITION BY key) AS seq FROM log UNION SELECT DISTINCT key, max(seq) OVER (PARTITION BY key) AS seq FROM log, n WHERE seq <= n * 25 // 100
 UNION SELECT DISTINCT key, max(seq) OVER (PARTITION BY key) AS seq FROM log, n WHERE seq <= n * 60 // 100),
kept AS (SELECT log.key, log.value, log.seq, log.tombstone FROM log JOIN k ON k.key = log.key AND k.seq = log.seq)"""


@query(_LOG + _RETAINED + "SELECT * FROM kept")
def pinned_retention(spark, sf):
    """Versions that the present or one of two snapshots sees."""
    log, last = _log(spark, sf)
    return merge.retain(log, _pins(last))


@query(_LOG + _RETAINED + "SELECT kept.* FROM kept, n WHERE tombstone AND seq < n * 25 // 100")
def tombstone_gc(spark, sf):
    """Tombstones that compaction into the bottom tier drops under two pinned snapshots."""
    log, last = _log(spark, sf)
    pins = _pins(last)
    return merge.retain(log, pins).where(F.col("tombstone") & (F.col("seq") < min(pins)))


@query(_LOG + _RETAINED + "SELECT kept.* FROM kept, n WHERE NOT (tombstone AND seq < n * 25 // 100)")
def compact_bottom_pinned(spark, sf):
    """Full compaction of four tiers under two pinned snapshots."""
    log, last = _log(spark, sf)
    return merge.compact(L.split_tiers(log, last), _pins(last), bottom=True)


@query("SELECT coalesce(min(snap_seq), 9223372036854775807) AS oldest_pinned FROM manifests WHERE outcome IS NULL OR lower(trim(outcome)) <> 'ok'")
def oldest_pinned(spark, sf):
    """Runs that haven't ended well still hold their snapshot."""
    snaps = L.table(spark, sf, "manifests").select(F.col("manifest_id").alias("id"), F.col("snap_seq").alias("seq"), F.coalesce(F.lower(F.trim("outcome")) == "ok", F.lit(False)).alias("released"))
    return merge.oldest_pinned(snaps)


_BYTES = "octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)"


@query(_LOG + f"SELECT level, count(*) AS entries, count(*) FILTER (tombstone) AS tombstones, CAST(sum({_BYTES} + 20) AS bigint) AS bytes, max(seq) AS max_seq FROM lv GROUP BY level")
def tier_stats(spark, sf):
    log, last = _log(spark, sf)
    return merge.tier_stats(log.withColumn("level", L.tier_of(F.col("seq"), last).cast("int")))


@query(_LOG + f"SELECT count(*) AS entries, CAST(sum({_BYTES} + 32) AS bigint) AS bytes, sum({_BYTES} + 32) >= 65536 AS is_full FROM lv WHERE level = 0")
def memtable_size(spark, sf):
    log, last = _log(spark, sf)
    size = F.sum(merge.entry_bytes(merge.MEM_OVERHEAD))
    return L.split_tiers(log, last)[0].agg(F.count("*").alias("entries"), size.alias("bytes"), (size >= FLUSH_BYTES).alias("is_full"))


_SEGMENTS = f""",
sg AS (SELECT *, coalesce(sum({_BYTES} + 32) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS segment FROM log)"""


@query(_LOG + _SEGMENTS + "SELECT seq, CAST(segment AS bigint) AS segment FROM sg")
def flush_segments(spark, sf):
    return merge.flush_segments(L.event_log(spark, sf), FLUSH_BYTES)


@query(_LOG + "SELECT CAST(epoch_us(ts) // 3600000000 AS bigint) AS \"group\", count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY 1")
def group_commit(spark, sf):
    """Records made durable together, an hour at a time."""
    return txn.group_commits(L.event_log(spark, sf), "ts", 3_600_000_000)


_ZONES = f""",
pg AS (SELECT key, coalesce(sum({_BYTES} + 20) OVER (ORDER BY key, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS page FROM lv WHERE level = 3),
zm AS (SELECT CAST(page AS bigint) AS page, count(*) AS entries, min(key) AS min_key, max(key) AS max_key FROM pg GROUP BY 1)"""


@query(_LOG + _ZONES + "SELECT * FROM zm")
def zone_map(spark, sf):
    """Key range of each page of the bottom tier."""
    log, last = _log(spark, sf)
    return order.zone_map(L.split_tiers(log, last)[3], PAGE_BYTES, merge.entry_bytes(merge.TIER_OVERHEAD))


@query(_LOG + _ZONES + "SELECT * FROM zm WHERE max_key >= 'user:000010' AND min_key < 'user:000060'")
def block_prune(spark, sf):
    """Pages that a range scan has to read."""
    return zone_map(spark, sf).where("max_key >= 'user:000010' and min_key < 'user:000060'")


# --- log and transactions --------------------------------------------------------------------------------------------


@query("""SELECT l.feed_pos, l.store, l.seq, l.key FROM wal_log l WHERE l.kind IN (0, 1) AND (coalesce(l.txn_id, 0) = 0
 OR EXISTS (SELECT 1 FROM wal_log c WHERE c.kind = 3 AND c.store = l.store AND c.txn_id = l.txn_id))""")
def wal_replay(spark, sf):
    return txn.replay(L.table(spark, sf, "wal_log"), ["store"]).select("feed_pos", "store", "seq", "key")


@query(_LOG + """, b AS (SELECT min(seq) AS cut FROM log, n WHERE seq * 10 > n * 9 AND (seq - 1) % 17 = 0)
SELECT key, value, seq FROM log, b WHERE cut IS NULL OR seq < cut""")
def wal_torn_tail(spark, sf):
    """Replay stops at the first record whose checksum doesn't hold; some in the last tenth are damaged here."""
    log, last = _log(spark, sf)
    sum_of = txn.checksum(F.col("seq"), F.col("key"), F.col("value"), F.col("tombstone"))
    damaged = (F.col("seq") * 10 > last * 9) & ((F.col("seq") - 1) % 17 == 0)
    stored = log.withColumn("crc", F.when(damaged, sum_of + 1).otherwise(sum_of))
    return txn.intact_prefix(stored, "seq", F.col("crc") == sum_of).select("key", "value", "seq")


@query(_LOG + "SELECT o_orderkey, n + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders, n")
def write_batch_seq(spark, sf):
    """All orders as one batch: one sequence number each, in order, after the log's last."""
    _, last = _log(spark, sf)
    return txn.sequence_batch(L.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], last).select("o_orderkey", "seq")


@query(_LOG + ",\nb AS (SELECT *, (seq - 1) // 100 AS batch, (seq - 1) % 100 AS ord FROM log)" + """SELECT batch, key, ord, value, tombstone FROM
(SELECT *, row_number() OVER (PARTITION BY batch, key ORDER BY ord DESC) AS r FROM b) WHERE r = 1""")
def write_batch_last_wins(spark, sf):
    ops = L.event_log(spark, sf).select("key", "value", "tombstone", F.floor((F.col("seq") - 1) / 100).alias("batch"), ((F.col("seq") - 1) % 100).alias("ord"))
    return txn.last_op_wins(ops, ["batch"])


@query(_LOG + """, s AS (SELECT key, value, tombstone, false AS own, seq AS o FROM lv WHERE level > 0 UNION ALL SELECT key, value, tombstone, true, seq FROM lv WHERE level = 0 AND txn_id > 0)
SELECT key, value, own FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY own DESC, o DESC) AS r FROM s) WHERE r = 1 AND NOT tombstone""")
def txn_read_your_writes(spark, sf):
    """A transaction that started at the end of the flushed tiers, with its own writes over them."""
    log, last = _log(spark, sf)
    writes = L.split_tiers(log, last)[0].where("txn_id > 0").withColumn("ord", F.col("seq"))
    return txn.read_own_writes(log, writes, last * 9 // 10)


_READS = """,
rd AS (SELECT CAST(substr(key, 6, 6) AS bigint) AS txn_id, key, max(seq) AS seq_seen FROM log, n WHERE seq * 10 <= n * 8 GROUP BY key),
now AS (SELECT key, max(seq) AS seq_now FROM log GROUP BY key),
cf AS (SELECT txn_id, rd.key, seq_seen, seq_now FROM rd JOIN now ON now.key = rd.key WHERE seq_now > seq_seen)"""


def _reads(log: DataFrame, last: int) -> DataFrame:
    """Per user a transaction that read all keys of the user."""
    seen = resolve.newest(log, at=last * 8 // 10, columns=[])
    return seen.select(F.substring("key", 6, 6).cast("long").alias("txn_id"), "key", F.col("seq").alias("seq_seen"))


@query(_LOG + _READS + "SELECT * FROM cf")
def txn_conflicts(spark, sf):
    log, last = _log(spark, sf)
    return txn.conflicts(_reads(log, last), log)


@query(_LOG + _READS + """, r AS (SELECT txn_id, count(*) AS reads FROM rd GROUP BY 1), c AS (SELECT txn_id, count(*) AS conflicts FROM cf GROUP BY 1),
w AS (SELECT CAST(substr(key, 6, 6) AS bigint) AS txn_id, count(*) AS writes FROM lv WHERE level = 0 AND txn_id > 0 GROUP BY 1)
SELECT txn_id, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes, coalesce(conflicts, 0) AS conflicts,
 CASE WHEN coalesce(writes, 0) > 0 AND coalesce(conflicts, 0) > 0 THEN 'CONFLICT' ELSE 'COMMITTED' END AS outcome
FROM r FULL JOIN w USING (txn_id) LEFT JOIN c USING (txn_id)""")
def txn_validate(spark, sf):
    log, last = _log(spark, sf)
    writes = L.split_tiers(log, last)[0].where("txn_id > 0").select(F.substring("key", 6, 6).cast("long").alias("txn_id"), "key")
    return txn.validate(_reads(log, last), writes, log)


@query(_LOG + _newest("log", "c", where="txn_id = 0 OR txn_id % 5 <> 0") + "SELECT key, value, seq FROM c WHERE NOT tombstone")
def txn_apply(spark, sf):
    """State after replay of begin, operation and commit records; every fifth transaction aborts."""
    log = L.event_log(spark, sf)
    ops = log.select("seq", "key", "value", "tombstone", "txn_id", F.when(F.col("tombstone"), 1).otherwise(0).alias("kind"))
    ends = log.where("txn_id > 0").select("txn_id").distinct()
    none = F.lit(None)
    marks = ends.select(none.cast("long").alias("seq"), none.cast("string").alias("key"), none.cast("string").alias("value"), F.lit(False).alias("tombstone"), "txn_id", F.when(F.col("txn_id") % 5 == 0, 4).otherwise(3).alias("kind"))
    return resolve.live(txn.replay(ops.unionByName(marks), [])).select("key", "value", "seq")


@query("""SELECT doc_id AS txn_id, CAST(1 AS bigint) AS ops, CASE WHEN text IS NULL OR text = '' THEN 'KEY_EMPTY' ELSE 'KEY_TOO_LARGE' END AS error
FROM documents WHERE text IS NULL OR text = '' OR octet_length(encode(text)) > 8192""")
def txn_limits(spark, sf):
    """Transactions with a speech as key: empty and too large ones."""
    return txn.limit_errors(L.table(spark, sf, "documents").select(F.col("doc_id").alias("txn_id"), F.col("text").alias("key"), F.col("source").alias("value")))


# --- column families -------------------------------------------------------------------------------------------------

_FAMILIES = _LOG + """, fl AS (SELECT 'customer' AS family, CAST(c_custkey AS varchar) AS key, c_name AS value, 0 AS seq, false AS tombstone FROM customer
UNION ALL SELECT 'orders', CAST(o_orderkey AS varchar), o_orderpriority, 0, false FROM orders UNION ALL SELECT 'part', CAST(p_partkey AS varchar), p_name, 0, false FROM part
UNION ALL SELECT event_type, key, value, seq, tombstone FROM log)""" + _newest("fl", "fc", "family, key")


@query(_FAMILIES + "SELECT key, value FROM fc WHERE family = 'customer' AND NOT tombstone")
def cf_scan(spark, sf):
    return resolve.live(families.family_rows(L.family_log(spark, sf), "customer")).select("key", "value")


@query(_FAMILIES + "SELECT key, count(DISTINCT family) AS families, count(DISTINCT value) AS \"values\" FROM fc WHERE NOT tombstone GROUP BY key HAVING count(DISTINCT family) > 1")
def cf_isolation(spark, sf):
    """Keys that live in several families, each with its own value."""
    both = resolve.live(L.family_log(spark, sf), ["family", "key"])
    return both.groupBy("key").agg(F.countDistinct("family").alias("families"), F.countDistinct("value").alias("values")).where("families > 1")


@query("SELECT DISTINCT event_type AS name FROM events UNION SELECT 'customer' UNION SELECT 'orders' UNION SELECT 'part'")
def cf_list(spark, sf):
    """Names in the registry, a JSON array in one row."""
    names = L.table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    registry = names.agg(F.to_json(F.array_union(F.collect_set("name"), F.array(*map(F.lit, ("customer", "orders", "part"))))).alias("json"))
    return families.list_families(families.parse_catalog(registry, "json"))


@query(_FAMILIES + "SELECT family, key, CAST(NULL AS varchar) AS value, n + 1 AS seq, true AS tombstone FROM fc, n WHERE family = 'view' AND NOT tombstone")
def cf_drop(spark, sf):
    log = L.family_log(spark, sf)
    return families.drop_family(log, "view", L.last_seq(log))


@query(_FAMILIES + "SELECT family, count(*) FILTER (NOT tombstone) AS live, count(*) FILTER (tombstone) AS deleted FROM fc GROUP BY family")
def cf_counts(spark, sf):
    return families.family_counts(L.family_log(spark, sf))


@query(_FAMILIES + "SELECT family, key, concat('00636600', hex(encode(family)), '00', hex(encode(key))) AS raw FROM (SELECT DISTINCT family, key FROM fl)")
def cf_key_codec(spark, sf):
    """Namespaced keys as bytes, taken apart again."""
    rows = L.family_log(spark, sf).select("family", "key").distinct().select(K.family_key(F.col("family"), F.encode("key", "UTF-8")).alias("raw"))
    family, key = K.split_family_key(F.col("raw"))
    return rows.select(family.alias("family"), F.decode(key, "UTF-8").alias("key"), F.hex("raw").alias("raw"))


# --- expiry ----------------------------------------------------------------------------------------------------------

_TTL = f""",
tl AS (SELECT key, CASE WHEN NOT tombstone THEN epoch_us(ts) * 1000 + 21600000000000 END AS expire_at_ns, seq, tombstone FROM log WHERE event_type IN ('signup', 'error')),
td AS (SELECT key, expire_at_ns FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM tl) WHERE r = 1 AND NOT tombstone)"""


@query(_LOG + _newest("log", "c") + _TTL + _WANTED + f"""SELECT w.key, CASE WHEN td.expire_at_ns <= {NOW_NS} THEN 'EXPIRED' WHEN c.seq IS NULL THEN 'NOT_FOUND' WHEN c.tombstone THEN 'DELETED' ELSE 'FOUND' END AS status,
 CASE WHEN NOT coalesce(td.expire_at_ns <= {NOW_NS}, false) AND NOT c.tombstone THEN c.value END AS value, CASE WHEN NOT coalesce(td.expire_at_ns <= {NOW_NS}, false) THEN c.seq END AS seq
FROM w LEFT JOIN c ON c.key = w.key LEFT JOIN td ON td.key = w.key""")
def ttl_get(spark, sf):
    log = L.event_log(spark, sf)
    return resolve.get_status(log, _wanted(spark, sf), deadlines=ttl.deadlines(L.ttl_log(log)), now_ns=NOW_NS)


@query(_LOG + _TTL + f"SELECT key, expire_at_ns - {NOW_NS} AS remaining_ns FROM td")
def ttl_of(spark, sf):
    return ttl.remaining(L.ttl_log(L.event_log(spark, sf)), NOW_NS)


@query(_LOG + _TTL + f"SELECT key, expire_at_ns FROM td WHERE expire_at_ns < {NOW_NS}")
def ttl_reap(spark, sf):
    return ttl.reap(L.ttl_log(L.event_log(spark, sf)), NOW_NS)


@query(_LOG + _newest("log", "c") + _TTL + f"SELECT c.key, c.value, c.seq FROM c LEFT JOIN td ON td.key = c.key WHERE NOT c.tombstone AND (td.expire_at_ns IS NULL OR td.expire_at_ns > {NOW_NS})")
def ttl_scan(spark, sf):
    log = L.event_log(spark, sf)
    return ttl.unexpired(resolve.live(log), L.ttl_log(log), NOW_NS).select("key", "value", "seq")


@query(_LOG + _TTL + f"""SELECT td.key, min(tl.expire_at_ns) AS first_ns, td.expire_at_ns AS last_ns FROM td JOIN tl ON tl.key = td.key WHERE tl.expire_at_ns IS NOT NULL AND td.expire_at_ns > {NOW_NS}
GROUP BY td.key, td.expire_at_ns HAVING min(tl.expire_at_ns) <= {NOW_NS}""")
def ttl_overwrite(spark, sf):
    """Keys that an earlier deadline would have ended and a newer one keeps."""
    rows = L.ttl_log(L.event_log(spark, sf))
    first = rows.groupBy("key").agg(F.min("expire_at_ns").alias("first_ns"))
    return ttl.deadlines(rows).where(F.col("expire_at_ns") > NOW_NS).join(first.where(F.col("first_ns") <= NOW_NS), "key").select("key", "first_ns", F.col("expire_at_ns").alias("last_ns"))


@query(_LOG + _TTL + "SELECT key, printf('%016X', expire_at_ns) AS raw, expire_at_ns AS decoded FROM td")
def ttl_codec(spark, sf):
    rows = ttl.deadlines(L.ttl_log(L.event_log(spark, sf))).withColumn("b", K.deadline_bytes(F.col("expire_at_ns")))
    return rows.select("key", F.hex("b").alias("raw"), K.deadline_ns(F.col("b")).alias("decoded"))


# --- secondary indexes -----------------------------------------------------------------------------------------------


def by_type(pk, value):
    return F.array(F.split_part(value, F.lit("|"), F.lit(1)))


def by_type_and_k(pk, value):
    return F.array(F.split_part(value, F.lit("|"), F.lit(1)), F.get_json_object(F.split_part(value, F.lit("|"), F.lit(2)), "$.k"))


_INDEX = _newest("log", "c") + ",\nix AS (SELECT split_part(value, '|', 1) AS index_key, key AS pk FROM c WHERE NOT tombstone)"
_OLD = _newest("log, n", "o", where="seq * 2 <= n") + ",\nxo AS (SELECT split_part(value, '|', 1) AS index_key, key AS pk FROM o WHERE NOT tombstone)"


@query(_LOG + _INDEX + "SELECT index_key, pk FROM ix")
def index_build(spark, sf):
    return index.build(L.event_log(spark, sf), by_type)


@query(_LOG + _newest("log", "c") + """, e AS (SELECT key AS pk, unnest([split_part(value, '|', 1), json_extract_string(split_part(value, '|', 2), '$.k')]) AS index_key FROM c WHERE NOT tombstone)
SELECT DISTINCT index_key, pk FROM e WHERE index_key IS NOT NULL""")
def index_multi(spark, sf):
    """Two index keys per record."""
    return index.build(L.event_log(spark, sf), by_type_and_k)


@query(_LOG + _INDEX + "SELECT pk FROM ix WHERE index_key = 'click'")
def index_point(spark, sf):
    return index.point(index.build(L.event_log(spark, sf), by_type), "click")


@query(_LOG + _INDEX + "SELECT index_key, pk FROM ix WHERE index_key >= 'click' AND index_key < 'signup'")
def index_range(spark, sf):
    return index.between(index.build(L.event_log(spark, sf), by_type), "click", "signup")


@query(_LOG + _INDEX + _OLD + """SELECT pk, index_key, 'ADD' AS change FROM (SELECT pk, index_key FROM ix EXCEPT SELECT pk, index_key FROM xo)
UNION ALL SELECT pk, index_key, 'REMOVE' FROM (SELECT pk, index_key FROM xo EXCEPT SELECT pk, index_key FROM ix)""")
def index_update(spark, sf):
    """Entries that the writes of the log's second half add and remove."""
    log, last = _log(spark, sf)
    return index.changes(resolve.newest(log, at=last // 2), resolve.newest(log), by_type)


@query(_LOG + _newest("log", "c") + _OLD + "SELECT xo.pk, xo.index_key FROM xo JOIN c ON c.key = xo.pk WHERE c.tombstone")
def index_delete(spark, sf):
    """Entries of records that the second half of the log deletes."""
    log, last = _log(spark, sf)
    now = resolve.newest(log)
    gone = now.where("tombstone").select(F.col("key").alias("g"))
    before = resolve.newest(log, at=last // 2).join(gone, F.col("key") == F.col("g"), "left_semi")
    return index.changes(before, now.where("tombstone"), by_type).select("pk", "index_key")


@query(_LOG + _INDEX + "SELECT ix.index_key, ix.pk, c.value FROM ix JOIN c ON c.key = ix.pk WHERE ix.index_key = 'purchase'")
def index_fetch(spark, sf):
    log = L.event_log(spark, sf)
    return index.fetch(index.build(log, by_type).where("index_key = 'purchase'"), log)


@query(_LOG + _INDEX + _OLD + """SELECT index_key, pk, 'STALE' AS state FROM (SELECT pk, index_key FROM xo EXCEPT SELECT pk, index_key FROM ix)
UNION ALL SELECT index_key, pk, 'MISSING' FROM (SELECT pk, index_key FROM ix EXCEPT SELECT pk, index_key FROM xo)""")
def index_consistency(spark, sf):
    """An index that was built half-way through the log, against the records now."""
    log, last = _log(spark, sf)
    return index.consistency(index.build(log.where(F.col("seq") <= last // 2), by_type), log, by_type)


# --- filters and caches ----------------------------------------------------------------------------------------------

_SIZES = ", z AS (SELECT level, count(DISTINCT key) AS keys FROM lv GROUP BY level), m AS (SELECT level, keys, CAST(ceil(-keys * ln(0.01::DOUBLE) / (ln(2) * ln(2))) AS bigint) AS m FROM z), k AS (SELECT *, CAST(greatest(1, round(m / keys * ln(2))) AS integer) AS k FROM m)"


def _sizes(spark, sf) -> DataFrame:
    log, last = _log(spark, sf)
    per = log.groupBy(L.tier_of(F.col("seq"), last).cast("int").alias("level")).agg(F.countDistinct("key").alias("keys"))
    m, _ = bloom.size_columns(F.col("keys"), F.lit(bloom.FPR_TARGET))
    per = per.withColumn("m", m)
    return per.withColumn("k", F.greatest(F.lit(1), F.round(F.col("m") / F.col("keys") * F.log(F.lit(2.0))).cast("int")))


@query(_LOG + _SIZES + "SELECT level, keys, m, k FROM k")
def bloom_sizing(spark, sf):
    return _sizes(spark, sf)


@query(_LOG + _SIZES + "SELECT level, round(pow(1 - exp(-k * keys / m), k), 9) AS fpr FROM k")
def bloom_fpr(spark, sf):
    return _sizes(spark, sf).select("level", F.round(bloom.theoretical_rate(F.col("keys"), F.col("m"), F.col("k")), 9).alias("fpr"))


def _filters(spark, sf) -> tuple[DataFrame, DataFrame, int, int]:
    stored = L.entry_log(spark, sf).where("key is not null").select(F.coalesce(F.col("level"), F.lit(-1)).cast("string").alias("file"), "key")
    m, k = bloom.size(max(1, stored.count()), bloom.FPR_TARGET)
    return bloom.build(stored, "file", "key", m, k), stored, m, k


@query("SELECT DISTINCT CAST(coalesce(level, -1) AS varchar) AS file, hex(key) AS key FROM entries WHERE key IS NOT NULL")
def bloom_members(spark, sf):
    """Every stored key passes the filter of its tier."""
    filters, stored, m, k = _filters(spark, sf)
    return bloom.probe(filters, stored, m, k).select("file", F.hex("key").alias("key"))


# The same filters as sets of bits, with hashes in whole numbers of 128 bits.
_U = "::UHUGEINT"
_BITS = f"""WITH s AS (SELECT DISTINCT CAST(coalesce(level, -1) AS varchar) AS file, key FROM entries WHERE key IS NOT NULL),
z AS (SELECT ceil(-n * ln(0.01::DOUBLE) / (ln(2) * ln(2))) AS m, n FROM (SELECT greatest(1, count(*)) AS n FROM entries WHERE key IS NOT NULL)),
mk AS (SELECT CAST(m AS UHUGEINT) AS m, CAST(greatest(1, floor(m / n * ln(2) + 0.5)) AS bigint) AS k FROM z),
i AS (SELECT DISTINCT key FROM incoming_entries WHERE key IS NOT NULL), q AS (SELECT key FROM i UNION SELECT key FROM s),
b AS (SELECT key, list_transform(range(octet_length(key)::BIGINT), lambda j: (strpos('123456789ABCDEF', substr(hex(key), 2 * j + 1, 1)) * 16 + strpos('123456789ABCDEF', substr(hex(key), 2 * j + 2, 1))){_U}) AS bytes FROM q),
f AS (SELECT key, list_reduce(list_prepend({bloom.FNV_OFFSET}{_U}, bytes), lambda h, x: (xor(h, x) * {bloom.FNV_PRIME}{_U}) % {2**64}{_U}) AS h FROM b),
g1 AS (SELECT key, h, xor(h, {bloom.GOLDEN}{_U}) AS g FROM f), g2 AS (SELECT key, h, (xor(g, g // {2**30}{_U}) * {bloom.MIX_1}{_U}) % {2**64}{_U} AS g FROM g1),
g3 AS (SELECT key, h, (xor(g, g // {2**27}{_U}) * {bloom.MIX_2}{_U}) % {2**64}{_U} AS g FROM g2), g4 AS (SELECT key, h, xor(g, g // {2**31}{_U}) AS g FROM g3),
p AS (SELECT key, ((h + (j{_U} * g) % {2**64}{_U}) % {2**64}{_U}) % m AS bit FROM (SELECT g4.*, m, unnest(range(k)) AS j FROM g4, mk)),
w AS (SELECT DISTINCT file, bit FROM s JOIN p USING (key)),
a AS (SELECT CAST(unnest([-1, 0, 1, 2, 3]) AS varchar) AS file, key FROM i),
r AS (SELECT a.file, a.key, bool_and(w.bit IS NOT NULL) AS passed FROM a JOIN p USING (key) LEFT JOIN w ON w.file = a.file AND w.bit = p.bit GROUP BY ALL)
"""


@query(_BITS + """SELECT r.file, count(*) AS asked, count(*) FILTER (passed) AS passed, count(*) FILTER (passed AND s.key IS NULL) AS false_positives
FROM r LEFT JOIN s ON s.file = r.file AND s.key = r.key GROUP BY r.file""")
def bloom_probe(spark, sf):
    """Per tier: new keys asked, passed by its filter, and passed wrongly."""
    filters, stored, m, k = _filters(spark, sf)
    tiers = F.array(*[F.lit(str(n)) for n in (-1, merge.MEM, merge.L0, merge.L1, merge.L2)])
    asked = L.table(spark, sf, "incoming_entries").where("key is not null").select("key").distinct().withColumn("file", F.explode(tiers))
    held = stored.distinct().withColumn("held", F.lit(True))
    passed = bloom.probe(filters, asked, m, k).withColumn("passed", F.lit(True))
    rows = asked.join(passed, ["file", "key"], "left").join(held, ["file", "key"], "left")
    return rows.groupBy("file").agg(F.count("*").alias("asked"), F.count("passed").alias("passed"), F.count_if(F.col("passed").isNotNull() & F.col("held").isNull()).alias("false_positives"))


@query("SELECT event_type AS file, count(*) AS queries, count(*) FILTER (event_id % 50 = 0) AS false_positives, round(count(*) FILTER (event_id % 50 = 0) / count(*), 9) AS observed_fpr FROM events GROUP BY 1")
def bloom_telemetry(spark, sf):
    asked = L.table(spark, sf, "events").select(F.col("event_type").alias("file"), (F.col("event_id") % 50 == 0).alias("is_false_positive"))
    return bloom.telemetry(asked).withColumn("observed_fpr", F.round("observed_fpr", 9))


@query("""WITH e AS (SELECT event_id, length(bin(user_id)) AS file FROM events), t AS (SELECT file, count(*) AS q, count(*) FILTER (event_id % (file * file) = 0) AS fp FROM e GROUP BY 1)
SELECT CAST(file AS varchar) AS file, q AS queries, fp AS false_positives, CASE WHEN q < 100 THEN 0.1::DOUBLE ELSE greatest(0.001::DOUBLE, least(0.05::DOUBLE, CASE WHEN fp / q > 0.1 THEN 0.05::DOUBLE WHEN fp / q < 0.025 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END)) END AS recommended FROM t""")
def bloom_recommend(spark, sf):
    """Next target rate of filters of tables that double in size from one to the next, from a target of a tenth."""
    file = F.length(F.bin("user_id"))
    asked = L.table(spark, sf, "events").select(file.cast("string").alias("file"), (F.col("event_id") % (file * file) == 0).alias("is_false_positive"))
    return bloom.telemetry(asked).select("file", "queries", "false_positives", bloom.recommend(F.col("queries"), F.col("false_positives"), F.lit(0.1)).alias("recommended"))


@query()
def arc_simulation(spark, sf):
    """Users' pages in one cache per kind of event."""
    trace = L.table(spark, sf, "events").select(F.col("event_type").alias("cache_id"), F.col("event_id").alias("step"), F.col("user_id").alias("key"))
    return cache.simulate(trace, 64)


# --- shipping and backup ---------------------------------------------------------------------------------------------


@query(_LOG + f", r AS (SELECT min(seq) AS low FROM (SELECT seq FROM log ORDER BY seq DESC LIMIT {RING})) SELECT key, value, log.seq, tombstone FROM log, r, n WHERE log.seq >= low AND log.seq * 2 > n")
def ring_since(spark, sf):
    """What a follower that has half the log still gets from the leader's ring."""
    log, last = _log(spark, sf)
    return ship.ring_since(log, last // 2).select("key", "value", "seq", "tombstone")


_APPLIED = """WITH s AS (SELECT store, key, value, seq, coalesce(tombstone, false) OR coalesce(kind = 1, false) AS dead FROM wal_records WHERE key IS NOT NULL AND seq IS NOT NULL AND (kind IS NULL OR kind IN (0, 1))),
a AS (SELECT store, key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY store, key ORDER BY seq DESC, dead DESC, value DESC NULLS LAST) AS r FROM s) WHERE r = 1 AND NOT dead)
"""


@query(_APPLIED + "SELECT * FROM a")
def replica_apply(spark, sf):
    """State of all stores after the shipped records, repeated and late ones included."""
    return resolve.live(ship.data_records(L.table(spark, sf, "wal_records")), ["store", "key"]).select("store", "key", "value", "seq")


@query(_APPLIED + "SELECT * FROM a")
def replica_apply_stream(spark, sf):
    """The same by a follower that reads the records as a stream."""
    source = L.table(spark, sf, "wal_records")
    at = scratch(spark, "follower")
    schema = ship.data_records(source).select("store", "key", "value", "seq", "tombstone").schema
    follower = ship.Follower(spark, at, schema, ["store"])
    follower.follow(L.stream_table(spark, sf, "wal_records"), f"{at}/checkpoint")
    return follower.state().select("store", "key", "value", "seq")


@query("""SELECT l.store, max(l.seq) AS leader_seq, coalesce(any_value(f.m), 0) AS follower_seq, greatest(max(l.seq) - coalesce(any_value(f.m), 0), 0) AS lag
FROM wal_records l LEFT JOIN (SELECT store, max(seq) AS m FROM wal_log GROUP BY store) f ON f.store = l.store GROUP BY l.store""")
def replica_lag(spark, sf):
    """How far the feed's stores are behind the shipped records."""
    return ship.lag(L.table(spark, sf, "wal_records"), L.table(spark, sf, "wal_log"), "store")


@query(_LOG + f""", r AS (SELECT min(seq) AS low FROM (SELECT seq FROM log ORDER BY seq DESC LIMIT 2000))
SELECT s_suppkey AS follower, (s_suppkey * 7919) % n AS last_seq, (s_suppkey * 7919) % n < low - 1 AS resync FROM supplier, n, r""")
def resync_needed(spark, sf):
    """A follower per supplier, somewhere in the log, and a ring of 2,000 records."""
    log, last = _log(spark, sf)
    followers = L.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("follower"), (F.col("s_suppkey") * 7919 % last).alias("last_seq"))
    return ship.resync_needed(log, followers, 2000)


@query(_LOG + _TTL + f"SELECT key, expire_at_ns FROM td WHERE expire_at_ns < {NOW_NS}")
def ttl_reap_stream(spark, sf):
    """Deadlines as a stream, then one sweep."""
    at = scratch(spark, "reaper")
    L.ttl_log(L.event_log(spark, sf)).write.parquet(f"{at}/source")
    schema = L.ttl_log(L.event_log(spark, sf)).schema
    return ship.sweep(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/source"), at, f"{at}/checkpoint", NOW_NS)


_LINE = "concat_ws('|', CAST(seq AS varchar), key, coalesce(value, '-'))"
_MANIFEST = f""",
mf AS (SELECT printf('seg_%06d', CAST(segment AS bigint)) AS name, sum({_BYTES} + 32) AS size, sha256(string_agg({_LINE}, ';' ORDER BY seq)) AS sha256 FROM sg GROUP BY segment)"""


def _segment_files(spark, sf) -> DataFrame:
    """Name, size and hash of each flushed segment; a segment has a bounded number of bytes, so its lines fit a row."""
    log = L.event_log(spark, sf)
    placed = log.join(merge.flush_segments(log, FLUSH_BYTES).withColumnRenamed("seq", "s"), F.col("seq") == F.col("s"))
    line = F.concat_ws("|", F.col("seq").cast("string"), "key", F.coalesce("value", F.lit("-")))
    got = placed.groupBy("segment").agg(F.sum(merge.entry_bytes(merge.MEM_OVERHEAD)).alias("size"), F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    return got.select(F.format_string("seg_%06d", "segment").alias("name"), "size", F.sha2(F.array_join(F.col("lines.line"), ";"), 256).alias("sha256"))


@query(_LOG + _SEGMENTS + _MANIFEST + "SELECT name, CAST(size AS bigint) AS size, sha256 FROM mf")
def backup_manifest(spark, sf):
    return _segment_files(spark, sf)


@query(_LOG + _SEGMENTS + _MANIFEST + "SELECT name, CASE WHEN CAST(right(name, 6) AS integer) % 3 = 0 THEN 'MISSING' ELSE 'SHA256' END AS problem FROM mf WHERE CAST(right(name, 6) AS integer) % 3 <> 1")
def restore_verify(spark, sf):
    """A backup in which every third segment is lost and every third damaged."""
    listed = _segment_files(spark, sf)
    number = F.substring("name", -6, 6).cast("int") % 3
    found = listed.where(number != 0).withColumn("sha256", F.when(number == 2, F.reverse("sha256")).otherwise(F.upper("sha256")))
    return verify(listed, found)


@query("SELECT store, manifest_id, snap_seq, files FROM (SELECT store, manifest_id, snap_seq, len(files) AS files, row_number() OVER (PARTITION BY store ORDER BY created_at DESC, manifest_id DESC, len(files) DESC) AS r FROM manifests WHERE lower(trim(outcome)) = 'ok') WHERE r = 1")
def newest_backup(spark, sf):
    """The backup to restore each store from."""
    good = L.table(spark, sf, "manifests").where("lower(trim(outcome)) = 'ok'")
    best = good.groupBy("store").agg(F.max(F.struct("created_at", "manifest_id", F.size("files").cast("long").alias("files"), "snap_seq")).alias("b"))
    return best.select("store", "b.manifest_id", "b.snap_seq", "b.files")
