"""Order over all rows of a frame without one task that sees them all: range partitions, and sums of those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import cut


def cumulated(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """df with before_x for each column x of sums: its sum over the rows before in order of keys, nulls first.

    A range exchange by the keys, a window inside each part, and the parts' sums, of which there is one row for each
    part. Rows tied in all keys are in one part, in any order.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    placed = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(*(F.sum(x).alias(f"__{x}") for x in sums))
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"__{x}") for x in sums))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(parts), "__part")
    made = [(F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"__{x}")).alias(f"before_{x}") for x in sums]
    return out.select(*(F.col(c) for c in df.columns), *made)


def cumulated_within(df: DataFrame, by: list[str], keys: list[str], sums: list[str]) -> DataFrame:
    """df with before_x and all_x for each column x of sums: its sum over the rows of the same `by` before in order of keys, and over all of them.

    The same range partitions, led by `by`: a group may span many and no window holds one. The columns of sums must not be negative;
    nulls in `by` are equal to each other. A group's beginning is the least sum before any of its rows.
    """
    placed = cut(cumulated(df, [*by, *keys], sums))
    whole = placed.groupBy(*by).agg(*(x for c in sums for x in (F.min(f"before_{c}").alias(f"__from_{c}"), F.sum(c).alias(f"all_{c}"))))
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"r.`{k}`").eqNullSafe(F.col(f"g.`{k}`"))
    out = placed.alias("r").join(whole.alias("g"), same)
    return out.select(*(F.col(f"r.`{c}`") for c in df.columns), *((F.col(f"r.before_{c}") - F.col(f"g.__from_{c}")).alias(f"before_{c}") for c in sums), *(F.col(f"g.all_{c}") for c in sums))


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, name (of columns), share, n and value: the quantiles of each column in each group, linear between neighbours.

    Values are counted, ranked by range partitions led by group and column, and those at the two places next to each quantile
    picked out; so any number of columns, groups and quantiles take one sort, and no task holds a group. Nulls and NaN
    are left out; a column without values in a group has no rows.
    """
    by = by or []
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns)))
    long = df.select(*by, one.alias("__x")).select(*by, F.col("__x.name").alias("name"), F.col("__x.v").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    counted = long.groupBy(*by, "name", "v").agg(F.count("*").alias("n"))
    ranked = cumulated_within(counted, [*by, "name"], ["v"], ["n"])
    placed = ranked.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("at", F.expr("(all_n - 1) * share"))
    holds = lambda place: (F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))
    low, high = F.floor("at"), F.ceil("at")
    near = placed.where(holds(low) | holds(high))
    ends = near.groupBy(*by, "name", "share").agg(F.first("all_n").alias("n"), F.first("at").alias("at"), F.max(F.when(holds(low), F.col("v"))).alias("low"), F.max(F.when(holds(high), F.col("v"))).alias("high"))
    return ends.select(*by, "name", "share", "n", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))


def roc_auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """by, n_pos, n_neg and auc (tied scores count half) of rows with a score and a mark; null where one kind lacks. One row without `by`."""
    by = by or []
    rows = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    tied = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("p"))
    r = cumulated_within(tied, by, ["score"], ["n"]) if by else cumulated(tied, ["score"], ["n"])
    total = r.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"), F.sum(F.col("p") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("ranks"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.select(*by, "n_pos", "n_neg", F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, pairs).alias("auc"))


def tiles(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df with tile from 1 to n in order of keys, as even as can be, larger ones first."""
    placed = cumulated(df.withColumn("__one", F.lit(1).cast("long")), keys, ["__one"])
    size = F.broadcast(placed.agg(F.count("*").alias("__size")))  # one row
    at, small = F.col("before___one"), F.floor(F.col("__size") / n)
    wide = (F.col("__size") % n) * (small + 1)
    tile = F.when(at < wide, F.floor(at / (small + 1))).otherwise(F.col("__size") % n + F.floor((at - wide) / F.greatest(small, F.lit(1)))) + 1
    return placed.crossJoin(size).select(*df.columns, tile.cast("long").alias("tile"))


def numbered_sessions(df: DataFrame, session: str = "session") -> DataFrame:
    """session and number from 0 of the different sessions: a row each, so a calendar bounds it at any number of rows."""
    return df.select(session).distinct().withColumn("number", F.row_number().over(Window.orderBy(session)) - 1)
