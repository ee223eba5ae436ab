"""Nanoseconds a record of bulk operations, next to published latencies of single ones: ``python bench_throughput.py [RECORDS]``."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F


def main(n: int) -> None:
    from verslog.operators import bloom, cache
    from verslog.session import local_session, materialize
    from verslog.sources.store import Config, Store

    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "throughput")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    folder, took = tempfile.mkdtemp(prefix="verslog-bench-"), {}

    def timed(name: str, records: int, run) -> None:
        began = time.time()
        run()
        took[name] = round((time.time() - began) * 1e9 / records)
        print(f"{name}: {took[name]} ns a record", file=sys.stderr, flush=True)

    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    key = lambda c: F.format_string("user:%012d", c)
    records = spark.range(n).select(key(F.col("id")).alias("key"), F.format_string("value %d", "id").alias("value"), F.lit(False).alias("tombstone"))
    drain(records)
    store = Store(spark, f"file://{folder}/db", Config(l0_runs=100))
    timed("put (one commit of all records)", n, lambda: store.write(records))
    store.flush()
    for i in range(3):
        store.write(records.where(F.pmod(F.xxhash64("key"), F.lit(4)) == i))
        store.flush()
    wanted = spark.range(n // 5).select(key(F.col("id") * 5).cast("binary").alias("key"))
    timed("get (a fifth of the keys at once)", n // 5, lambda: drain(store.multi_get(wanted)))
    timed("get with expiry check", n // 5, lambda: drain(store.multi_get(wanted, now_ns=0)))
    timed("scan of four runs in key order", n, lambda: drain(store.scan()))
    timed("compaction of four runs", 7 * n // 4, lambda: store.compact(to_bottom=True))
    timed("scan after compaction", n, lambda: drain(store.scan()))
    some = n // 5
    m, k = bloom.size(some, 0.01)
    stored = spark.range(some).select(F.lit("f").alias("file"), key(F.col("id")).cast("binary").alias("key"))
    timed("filter build", some, lambda: drain(bloom.build(stored, "file", "key", m, k)))
    filters = materialize(bloom.build(stored, "file", "key", m, k), "filters")
    absent = spark.range(some).select(F.lit("f").alias("file"), F.format_string("none:%012d", "id").cast("binary").alias("key"))
    timed("filter probe of absent keys", some, lambda: drain(bloom.probe(filters, absent, m, k)))
    trace = spark.range(n // 5).select((F.col("id") % 64).alias("cache_id"), F.col("id").alias("step"), F.pmod(F.xxhash64("id"), F.lit(3000)).alias("key"))
    timed("cache get", n // 5, lambda: drain(cache.simulate(trace, 1024)))
    spark.stop()
    shutil.rmtree(folder)
    print(json.dumps({"records": n, "ns_per_record": took}))


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 5_000_000)
