"""A walk through the store: ``python -m verslog.demo FOLDER``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from verslog.sources import backup
from verslog.sources.store import Store, TxnConflict
from verslog.streaming.ship import Follower


def run(spark: SparkSession, folder: str) -> dict:
    """Bulk writes, a transfer and a conflict, prefix scans, backup and restore, and a follower; gives what was seen."""
    store, seen = Store(spark, f"{folder}/db"), {}
    users = spark.range(1000).select(F.format_string("user:%04d", "id").alias("key"), F.format_string("name %d", "id").alias("value"))
    seen["last_seq"] = store.write(users, ["key"])
    store.batch([(b"account:alice", b"1000"), (b"account:bob", b"500")])
    transfer = store.begin()
    a, b = int(transfer.get(b"account:alice")), int(transfer.get(b"account:bob"))
    transfer.put(b"account:alice", b"%d" % (a - 100))
    transfer.put(b"account:bob", b"%d" % (b + 100))
    transfer.commit()
    late = store.begin()
    late.get(b"account:alice")
    store.put(b"account:alice", b"0")
    late.put(b"account:alice", b"1")
    try:
        late.commit()
    except TxnConflict:
        seen["conflict"] = True
    seen["forward"] = [bytes(r.key).decode() for r in store.prefix_scan(b"account:").collect()]
    seen["reverse"] = [bytes(r.key).decode() for r in store.prefix_scan(b"user:099", reverse=True, limit=2).collect()]
    seen["backup"] = store.backup(f"{folder}/backup", "2025-01-01T00:00:00Z")["snap_seq"]
    backup.restore(spark, f"{folder}/backup", f"{folder}/restored")
    seen["restored"] = Store(spark, f"{folder}/restored").scan().count()
    shipped = store.log().select("family", "key", "value", "seq", "tombstone", F.lit(None).cast("int").alias("kind"))
    shipped.write.parquet(f"{folder}/shipped")
    follower = Follower(spark, f"{folder}/follower", shipped.drop("kind").schema, ["family"])
    follower.follow(spark.readStream.schema(shipped.schema).parquet(f"{folder}/shipped"), f"{folder}/follower/checkpoint")
    seen["follower"] = follower.state().count()
    store.close()
    return seen


if __name__ == "__main__":
    from verslog.session import local_session

    for what, value in run(local_session(), sys.argv[1]).items():
        print(f"{what}: {value}")
