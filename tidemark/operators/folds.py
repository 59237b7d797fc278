"""Purged chronological folds: which rows test and which train, by the sessions at which their labels end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import numbered_sessions


def fold_edges(df: DataFrame, n_folds: int) -> DataFrame:
    """fold (from 1), first and last session of each test fold: the sessions cut at floor(k * sessions / n_folds).

    The first of the n_folds parts only trains. A part without sessions is no fold. At most n_folds rows.
    """
    if n_folds < 2:
        raise ValueError("n_folds must be at least 2")
    days = numbered_sessions(df)
    # Edges are k * size / n_folds, cut off: session s is in part k if edge(k) <= s < edge(k + 1).
    size = F.broadcast(days.agg(F.count("*").alias("size")))
    part = F.floor(((F.col("number") + 1) * n_folds - 1) / F.col("size"))
    return days.crossJoin(size).select("session", part.alias("fold")).where("fold >= 1").groupBy("fold").agg(F.min("session").alias("first"), F.max("session").alias("last"))


def purged_folds(df: DataFrame, n_folds: int = 5) -> DataFrame:
    """df's rows by fold and role: `test` in their own fold, `train` in each fold that begins after their label's end.

    df has session and label_end; rows without a label_end are in no fold, though their sessions count for the edges. The
    few edges go to every task; a row is repeated once for each fold it trains.
    """
    edges = F.broadcast(fold_edges(df, n_folds))
    rows = df.where("label_end IS NOT NULL").join(edges, F.col("session").between(F.col("first"), F.col("last")) | (F.col("label_end") < F.col("first")))
    return rows.withColumn("role", F.when(F.col("session").between(F.col("first"), F.col("last")), "test").otherwise("train")).drop("first", "last")


def eligible(df: DataFrame, asof: DataFrame) -> DataFrame:
    """session and n of each session of asof: how many rows of df have a label that ended before it.

    Counts by label_end are cumulated over the calendar, so rows are never met with sessions.
    """
    ends = df.where("label_end IS NOT NULL").groupBy(F.col("label_end").alias("session")).agg(F.count("*").alias("n"))
    both = ends.unionByName(asof.select("session").distinct().withColumn("n", F.lit(None).cast("long")))
    day = F.datediff("session", F.lit("1970-01-01").cast("date"))
    before = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("day", day).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return out.where("n IS NULL").select("session", F.col("before").alias("n"))
