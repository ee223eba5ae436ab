"""Replay of a log with transactions, write batches, and optimistic validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verslog.operators.changes import COMMIT, DELETE, PUT
from verslog.operators.order import number_rows
from verslog.operators.resolve import newest

#: Limits of a transaction.
MOST_OPS, MOST_KEY_BYTES, MOST_VALUE_BYTES = 10_000, 8 << 10, 64 << 20


def checksum(*columns: Column) -> Column:
    """CRC-32 of a record's fields; NULL fields count as a byte that text doesn't hold."""
    return F.crc32(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]))


def intact_prefix(log: DataFrame, seq: str, good: Column) -> DataFrame:
    """The log before its first bad record (``good`` false or NULL): a torn tail is cut off. The cut is one number, found first,
    and then a bound that the scan skips row groups by."""
    cut = log.where(~F.coalesce(good, F.lit(False))).agg(F.min(seq)).first()[0]
    return log if cut is None else log.where(F.col(seq) < cut)


def replay(log: DataFrame, scope: list[str], salts: int = 8) -> DataFrame:
    """Puts and deletes outside transactions (txn_id 0 or NULL) or of transactions with a commit marker in their scope; markers
    and records of other kinds go. Commit markers are repeated per salt so that one large transaction is several tasks."""
    data = log.where(F.col("kind").isin(PUT, DELETE))
    outside = F.coalesce(F.col("txn_id"), F.lit(0)) == 0
    names = [f"__s{i}" for i in range(len(scope))]
    commits = log.where((F.col("kind") == COMMIT) & (F.col("txn_id") != 0)).select(*[F.col(c).alias(n) for c, n in zip(scope, names)], F.col("txn_id").alias("__t")).distinct()
    commits = commits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [F.col(c) == F.col(n) for c, n in zip(scope, names)] + [F.col("txn_id") == F.col("__t"), F.pmod(F.hash("seq", "key"), F.lit(salts)) == F.col("__salt")]
    return data.where(outside).unionByName(data.where(~outside).join(commits, on, "left_semi"))


def sequence_batch(ops: DataFrame, order: list[Column], last_seq: int) -> DataFrame:
    """Gives each operation of a batch its own seq, in order, after ``last_seq``."""
    return number_rows(ops, order, "seq", last_seq + 1)


def last_op_wins(ops: DataFrame, batch: list[str]) -> DataFrame:
    """The last operation (largest ord) on each key of each batch."""
    v = F.struct(F.col("ord").alias("ord"), F.col("tombstone").alias("tombstone"), F.col("value").alias("value"))
    return ops.groupBy(*batch, "key").agg(F.max(v).alias("v")).select(*batch, "key", "v.ord", "v.value", "v.tombstone")


def read_own_writes(log: DataFrame, writes: DataFrame, at: int) -> DataFrame:
    """(key, value, own) as a transaction sees its store: its own last writes (key, value, tombstone, ord) over the snapshot."""
    v = F.struct(F.col("own").alias("own"), F.col("n").alias("n"), F.col("tombstone").alias("tombstone"), F.col("value").alias("value"))
    snap = newest(log, at=at).select("key", "value", "tombstone", F.lit(False).alias("own"), F.col("seq").alias("n"))
    mine = writes.select("key", "value", "tombstone", F.lit(True).alias("own"), F.col("ord").cast("long").alias("n"))
    return snap.unionByName(mine).groupBy("key").agg(F.max(v).alias("v")).where("not v.tombstone").select("key", "v.value", "v.own")


def conflicts(reads: DataFrame, log: DataFrame) -> DataFrame:
    """Reads (txn_id, key, seq_seen; 0 for an absent key) whose key has a newer version by now, with its seq. Only versions of read keys
    above the oldest one seen are aggregated."""
    asked = reads.groupBy(F.col("key").alias("__k")).agg(F.min("seq_seen").alias("__s"))
    now = log.join(asked, (F.col("key") == F.col("__k")) & (F.col("seq") > F.col("__s")), "left_semi").groupBy("key").agg(F.max("seq").alias("seq_now"))
    return reads.join(now, "key").where("seq_now > seq_seen").select("txn_id", "key", "seq_seen", "seq_now")


def validate(reads: DataFrame, writes: DataFrame, log: DataFrame) -> DataFrame:
    """(txn_id, reads, writes, conflicts, outcome) per transaction: one without writes always commits, else any conflict aborts."""
    bad = conflicts(reads, log).groupBy("txn_id").agg(F.count("*").alias("conflicts"))
    r = reads.groupBy("txn_id").agg(F.count("*").alias("reads"))
    w = writes.groupBy("txn_id").agg(F.count("*").alias("writes"))
    both = r.join(w, "txn_id", "full").join(bad, "txn_id", "left").na.fill(0, ["reads", "writes", "conflicts"])
    return both.withColumn("outcome", F.when((F.col("writes") > 0) & (F.col("conflicts") > 0), "CONFLICT").otherwise("COMMITTED")).select("txn_id", "reads", "writes", "conflicts", "outcome")


def limit_errors(ops: DataFrame) -> DataFrame:
    """(txn_id, ops, error) for transactions beyond a limit: KEY_EMPTY, KEY_TOO_LARGE, VALUE_TOO_LARGE, else TOO_MANY_OPS."""
    key, value = F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0))
    got = ops.groupBy("txn_id").agg(F.count("*").alias("ops"), F.bool_or(key.isNull() | (key == 0)).alias("e"), F.bool_or(key > MOST_KEY_BYTES).alias("k"), F.bool_or(value > MOST_VALUE_BYTES).alias("v"))
    error = F.when(F.col("e"), "KEY_EMPTY").when(F.col("k"), "KEY_TOO_LARGE").when(F.col("v"), "VALUE_TOO_LARGE").when(F.col("ops") > MOST_OPS, "TOO_MANY_OPS")
    return got.select("txn_id", "ops", error.alias("error")).where("error is not null")


def group_commits(log: DataFrame, stamp: str, window_us: int) -> DataFrame:
    """(group, records, first_seq, last_seq): records that one flush of the given interval makes durable."""
    # unix_micros needs an instant; the session's zone is UTC and times carry none.
    return log.groupBy(F.floor(F.unix_micros(F.col(stamp).cast("timestamp")) / window_us).alias("group")).agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
