"""Session settings and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "verslog") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitting side configures the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of its own (tests);
    a cluster has to name one, because a folder of one machine can't be read by the others."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="verslog-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    at = f"{shared_folder(spark)}/verslog-{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    return at


@contextmanager
def temporary(spark: SparkSession):
    """Removes at its end what was materialized within; nothing lazy over it may be used afterwards."""
    mark = len(_MADE)
    try:
        yield
    finally:
        for at in _MADE[mark:]:
            discard(spark, at)
        del _MADE[mark:]


def discard(spark: SparkSession, at: str) -> None:
    path, fs = _path(spark, at)
    fs.delete(path, True)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    at = scratch(spark, name)
    _MADE.append(at)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once an application, for sessions that weren't started with it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="verslog-package-")) / "verslog.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    _SHIPPED.add(sc.applicationId)
