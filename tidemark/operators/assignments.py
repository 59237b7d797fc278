"""Histories of group assignments out of overlapping evidence of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REVIEW = "review"


def assignment_intervals(evidence: DataFrame, members: DataFrame, priority: list[str], dated: list[str]) -> DataFrame:
    """ticker, effective_from, effective_to (null: open), source, code: who is what, from the beginning of the evidence to its observation.

    evidence: ticker, source, code, effective_from, effective_to (exclusive, null: open), observed_at. members: ticker, history_start and
    observed (the last day that is known), one row each. At any time the first source of `priority` with a valid record
    counts; without one the ticker is in `review`. Sources of `dated` were derived from what was seen on observed_at and don't count before
    it, so nothing is backdated. Neighbours of equal source and code are one interval. Two records of one source that
    overlap are an error, found before anything is built. Null dates of a record's beginning count as the history's.

    A sweep: each ticker's boundaries are sorted once, and each source's newest record is carried along them; a task holds a
    ticker's records. A record that ends before the history or begins behind the observation has no part.
    """
    rows = evidence.join(members, "ticker").where(F.col("source").isin(priority))
    start = F.greatest(F.coalesce("effective_from", "history_start"), F.col("history_start"), *([F.when(F.col("source").isin(dated), F.col("observed_at"))] if dated else []))
    rows = rows.select("ticker", "source", "code", start.alias("f"), F.col("effective_to").alias("t"), "observed")
    rows = rows.where("f <= observed AND (t IS NULL OR t > f)")
    one = Window.partitionBy("ticker", "source").orderBy("f", F.col("t").asc_nulls_last())
    ends = F.max(F.coalesce("t", F.lit("9999-12-31").cast("date"))).over(one.rowsBetween(Window.unboundedPreceding, -1))
    clash = rows.select("ticker", "source", "f", ends.alias("before")).where("before > f").limit(3).collect()
    if clash:
        raise ValueError(f"overlapping records of one source: {clash}")
    at = rows.select("ticker", "f", F.struct("source", "code", "t").alias("r"))
    edges = at.unionByName(rows.where("t <= observed").select("ticker", F.col("t").alias("f"), F.lit(None).cast(at.schema["r"].dataType).alias("r")))
    edges = edges.unionByName(members.where("history_start <= observed").select("ticker", F.col("history_start").alias("f"), F.lit(None).cast(at.schema["r"].dataType).alias("r")))
    points = edges.groupBy("ticker", "f").agg(*(F.max(F.when(F.col("r.source") == s, F.col("r"))).alias(f"s{i}") for i, s in enumerate(priority)))
    along = Window.partitionBy("ticker").orderBy("f")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    carried = points.select("ticker", "f", F.lead("f").over(along).alias("next"), *(F.last(f"s{i}", ignorenulls=True).over(upto).alias(f"s{i}") for i in range(len(priority))))
    valid = [F.when(F.col(f"s{i}.t").isNull() | (F.col(f"s{i}.t") > F.col("f")), F.struct(F.col(f"s{i}.source"), F.col(f"s{i}.code"))) for i in range(len(priority))]
    known = [F.when(F.col(f"s{i}").isNotNull(), v) for i, v in enumerate(valid)]
    picked = carried.withColumn("w", F.coalesce(*known, F.struct(F.lit(REVIEW).alias("source"), F.lit(None).cast("string").alias("code"))))
    new = F.when(F.lag("w").over(along).eqNullSafe(F.col("w")), 0).otherwise(1)
    islands = picked.withColumn("new", new).withColumn("island", F.sum("new").over(upto))
    joined = islands.groupBy("ticker", "island").agg(F.min("f").alias("effective_from"), F.max_by("next", "f").alias("effective_to"), F.first("w").alias("w"))
    return joined.select("ticker", "effective_from", "effective_to", F.col("w.source").alias("source"), F.col("w.code").alias("code"))
