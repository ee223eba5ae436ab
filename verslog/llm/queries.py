"""Queries p1 and p7 to p9 over the test tables, and the equal SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verslog.llm.leak import RUN, find_leaks
from verslog.llm.pack import SHARD_ITEMS, count_tokens, pack
from verslog.llm.seen import error_rate, seen_before
from verslog.llm.sentences import sentence_units, split_sentences


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals whose key is stored already or came earlier."""
    return seen_before(_read(spark, sf, "entries"), _read(spark, sf, "incoming_entries"), "key", "arrival_id")


def p1_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    """How often fingerprints of 8, 16 and 32 bits give a wrong answer on these tables."""
    return error_rate(_read(spark, sf, "entries"), _read(spark, sf, "incoming_entries"), "key", "arrival_id")


def p1_batches(spark: SparkSession, sf: str) -> DataFrame:
    """As p1_found, with the arrivals in three batches of which each adds its keys to the sealed set before the next."""
    return seen_before(_read(spark, sf, "entries"), _read(spark, sf, "incoming_entries"), "key", "arrival_id", batches=3)


def p1_asked(spark: SparkSession, sf: str) -> DataFrame:
    """What p1_error_rate asks: keys, new ones among them, and seen ones that were missed."""
    return p1_error_rate(spark, sf).select("fingerprint_bits", "asked", "new_keys", "missed")


def p1_generations(spark: SparkSession, sf: str) -> DataFrame:
    """How the rate of wrong answers grows with the number of generations that a key is held against."""
    rates = [error_rate(_read(spark, sf, "entries"), _read(spark, sf, "incoming_entries"), "key", "arrival_id", (8, 16), g).withColumn("generations", F.lit(g)) for g in (1, 2, 4)]
    return rates[0].unionByName(rates[1]).unionByName(rates[2])


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every speech, by tokens, in windows of each container's capacity."""
    containers = _read(spark, sf, "containers").where("container_id is not null and capacity_tokens > 0").select("container_id", "capacity_tokens").distinct().toLocalIterator()
    sized = count_tokens(_read(spark, sf, "documents").select("doc_id", "text"), "text")
    docs = _read(spark, sf, "documents").count()
    return pack(sized, "doc_id", "tokens", [tuple(r) for r in containers], shards=max(1, -(-docs // SHARD_ITEMS)))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, tokens and share of the room used, per container."""
    caps = _read(spark, sf, "containers").select("container_id", "capacity_tokens")
    used = p7_pack(spark, sf).groupBy("container_id", "window").agg(F.sum("tokens").alias("tokens")).groupBy("container_id").agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"))
    return used.join(caps, "container_id").withColumn("used", F.col("tokens") / (F.col("windows") * F.col("capacity_tokens")))


def p7_account(spark: SparkSession, sf: str) -> DataFrame:
    """Per container: speeches that were assigned, speeches that were divided without need, and windows over the capacity."""
    pieces = p7_pack(spark, sf).join(_read(spark, sf, "containers").select("container_id", "capacity_tokens"), "container_id")
    docs = pieces.groupBy("container_id", "capacity_tokens", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    docs = docs.groupBy("container_id").agg(F.count("*").alias("docs"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("divided_needlessly"))
    windows = pieces.groupBy("container_id", "capacity_tokens", "window").agg(F.sum("tokens").alias("tokens"))
    over = windows.groupBy("container_id").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"))
    return docs.join(over, "container_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Speeches that share a run of 40 letters and numbers with a test item."""
    return find_leaks(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Test items that leaked, with the number of speeches."""
    return p8_found(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of the sentence units of every speech."""
    return split_sentences(_read(spark, sf, "documents"))


def p9_units(spark: SparkSession, sf: str) -> DataFrame:
    """Speeches by their number of units."""
    units = p9_found(spark, sf).groupBy("doc_id").agg(F.count("*").alias("units"))
    return units.groupBy("units").agg(F.count("*").alias("docs"))


#: White space as the units see it.
_BLANKS = "[\\t-\\r\\x1c-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def p9_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each speech that stand in its units, white space left out: all of them, and none twice."""
    units = sentence_units(_read(spark, sf, "documents"))
    return units.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("unit", _BLANKS, ""))).alias("chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_error_rate, p1_batches, p1_asked, p1_generations, p7_pack, p7_fill, p7_account, p8_found, p8_items, p9_found, p9_units, p9_cover)}

_P8 = rf"""WITH n AS (SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_replace(lower(nfc_normalize(text)), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM eval_items WHERE text IS NOT NULL),
a AS (SELECT item_id, substr(t, p, {RUN}) AS g FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - {RUN - 2}, 1)::BIGINT)) AS p FROM i)),
b AS (SELECT doc_id, substr(t, p, {RUN}) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - {RUN - 2}, 1)::BIGINT)) AS p FROM n)),
f AS (SELECT DISTINCT a.item_id, b.doc_id FROM b JOIN (SELECT DISTINCT item_id, g FROM a) a ON a.g = b.g)
"""

_P1 = """WITH i AS (SELECT arrival_id, key, row_number() OVER (PARTITION BY key ORDER BY arrival_id) AS r FROM incoming_entries WHERE key IS NOT NULL)
SELECT arrival_id FROM i WHERE r > 1 OR EXISTS (SELECT 1 FROM entries e WHERE e.key = i.key)"""

ORACLE = {
    "p1_batches": _P1,
    "p1_asked": """WITH k AS (SELECT DISTINCT key FROM incoming_entries WHERE key IS NOT NULL), n AS (SELECT count(*) AS asked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM entries e WHERE e.key = k.key)) AS new_keys FROM k)
SELECT b AS fingerprint_bits, asked, new_keys, 0 AS missed FROM n, unnest([8, 16, 32]) AS u(b) WHERE asked > 0""",
    "p9_cover": f"""SELECT doc_id, length(t) AS chars FROM (SELECT doc_id, regexp_replace(text, '{_BLANKS}', '', 'g') AS t FROM documents) WHERE t <> ''""",
    "p1_found": _P1,
    "p7_account": "SELECT container_id, (SELECT count(*) FROM documents) AS docs, 0 AS divided_needlessly, 0 AS overfull FROM containers",
    "p8_found": _P8 + "SELECT item_id, doc_id FROM f",
    "p8_items": _P8 + "SELECT item_id, count(*) AS docs FROM f GROUP BY item_id",
}
