"""Column families: namespaces within one log, held in a column ``family`` ('' is the default one)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verslog.operators.resolve import live, newest


def check_name(name: str) -> str:
    if not name or "\x00" in name:
        raise ValueError("a name of a family or index must not be empty or hold a zero byte")
    return name


def family_rows(log: DataFrame, name: str) -> DataFrame:
    """One family's versions; prunes partitions where the log is partitioned by family."""
    return log.where(F.col("family") == name)


def list_families(catalog: DataFrame) -> DataFrame:
    """Distinct non-empty names of a catalog (name), in order."""
    return catalog.where("name <> ''").select("name").distinct().orderBy("name")


def parse_catalog(raw: DataFrame, column: str) -> DataFrame:
    """Names in a JSON array of a registry row."""
    return raw.select(F.explode(F.from_json(column, "array<string>")).alias("name"))


def drop_family(log: DataFrame, name: str, last_seq: int) -> DataFrame:
    """Tombstones (family, key, value, seq, tombstone) for the live keys of a family, all at the seq after ``last_seq``: one
    commit, so the family goes at once."""
    return live(family_rows(log, name), ["family", "key"]).select("family", "key", F.lit(None).cast("string").alias("value"), F.lit(last_seq + 1).cast("long").alias("seq"), F.lit(True).alias("tombstone"))


def family_counts(log: DataFrame) -> DataFrame:
    """Live and deleted keys per family."""
    return newest(log, ["family", "key"]).groupBy("family").agg(F.count_if(~F.col("tombstone")).alias("live"), F.count_if("tombstone").alias("deleted"))
