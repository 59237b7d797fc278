"""Sharding: weighted rendezvous hashing of record keys, and gapless slots inside each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import apart, in_order

SHARDS = 24


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard decide: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (index into weights) whose score -ln(draw) / weight is least for this key.

    A shard wins a share of the keys in proportion to its weight. Adding a shard moves only the
    keys that it wins; shards of weight 0 win none. A null key counts as the empty string.
    """
    live = [(s, w) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("at least one shard needs a weight above 0")
    scores = [F.struct((-F.log(_draw(key, s)) / float(w)).alias("score"), F.lit(s).alias("shard")) for s, w in live]
    return (scores[0] if len(scores) == 1 else F.least(*scores))["shard"]


def shard_rows(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Columns key, *keep, shard, grown_shard and slot: the place in the shard in order of key.

    grown: the weights after a change; grown_shard is where the row would be then (null without it).
    An empty table gives no rows. Repeated rows get a slot each; rows of one key follow each other in any order. A null
    key counts as the empty string and comes first. Carried columns named like a result's get an underscore.
    """
    names = [key, *keep]
    placed = df.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)),
        rendezvous(F.col(f"`{key}`"), weights).alias("shard"),
        (rendezvous(F.col(f"`{key}`"), grown) if grown is not None else F.lit(None).cast("int")).alias("grown_shard"),
    )
    ordered = in_order(placed, ["shard", "c0"], "shards")  # the sample that finds the ranges reads only the key
    # One row for each range partition and shard in it: as many as partitions and shards together, whatever the input.
    starts = ordered.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", "shard", (before - F.col("first")).alias("shift"))
    out = ordered.join(F.broadcast(starts), ["part", "shard"])
    shown = apart(names, ["shard", "grown_shard", "slot"])
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(shown)), "shard", "grown_shard", (F.col("row") + F.col("shift")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight under the law `key`; a null text has no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(sized, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1), ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP1_SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), sized AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), crc AS (
  SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32
  FROM sized, crc_table
), draws AS (
  SELECT doc_id, s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS score
  FROM (SELECT DISTINCT doc_id FROM documents), (SELECT unnest(range({SHARDS + 1})) AS s)
), won AS (
  SELECT doc_id, arg_min(s, score) FILTER (s < {SHARDS})::INTEGER AS shard, arg_min(s, score)::INTEGER AS grown_shard FROM draws GROUP BY doc_id
)
SELECT crc.doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY crc.doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM crc JOIN won ON crc.doc_id IS NOT DISTINCT FROM won.doc_id
"""
