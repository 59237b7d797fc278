"""Queries over order and folds, and SQL for them that is written apart from the Spark side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import folds, order
from tidemark.operators import layers as L
from tidemark.plans import layered, relational
from tidemark.sources import bars as B

Q = relational.duck_sql


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stack(layered.base(spark, sf_dir, "week", True), relational.FEATURES)


def a14_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.roc_auc(_features(spark, sf_dir), "vr", "tail_down").select(F.round("auc", 6).alias("auc"))


A14_SQL = Q(
    "WITH r AS (SELECT tail_down AS y, rank() OVER (ORDER BY vr) + (count(*) OVER (PARTITION BY vr) - 1) / 2D AS k FROM $features WHERE vr IS NOT NULL AND tail_down IS NOT NULL) "
    "SELECT round((sum(CASE WHEN y THEN k ELSE 0D END) - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auc FROM (SELECT y, k, sum(CASE WHEN y THEN 1D ELSE 0D END) OVER () AS p, sum(CASE WHEN y THEN 0D ELSE 1D END) OVER () AS q FROM r) t GROUP BY p, q"
)


def a17_quintile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir).where("vr IS NOT NULL AND fwd IS NOT NULL").select("vr", "ticker", "session", F.least("fwd", F.lit(5.0)).alias("fwd"))
    return order.tiles(f, ["vr", "ticker", "session"], 5).groupBy(F.col("tile").alias("q")).agg(F.count("*").alias("n"), F.round(F.avg("fwd"), 6).alias("mean_fwd"))


A17_SQL = Q("SELECT q, count(*) AS n, round(avg(fwd), 6) AS mean_fwd FROM (SELECT ntile(5) OVER (ORDER BY vr, ticker, session) AS q, least(fwd, 5D) AS fwd FROM $features WHERE vr IS NOT NULL AND fwd IS NOT NULL) t GROUP BY q")


def w35_strict_past_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each close against the ticker's closes of the same calendar month before it, of which the calendar bounds the number."""
    past = Window.partitionBy("ticker", F.month("session")).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    rows = B.bars(spark, sf_dir).select("ticker", "session", "close", F.collect_list("close").over(past).alias("past"))
    below = F.size(F.filter("past", lambda x: x < F.col("close")))
    return rows.where(F.size("past") >= 8).select("ticker", F.col("session").cast("string").alias("session"), F.size("past").cast("long").alias("n"), F.round(below / F.size("past"), 6).alias("pct"))


W35_SQL = Q("SELECT a.ticker, CAST(a.session AS STRING) AS session, count(*) AS n, round(avg(CASE WHEN b.close < a.close THEN 1D ELSE 0D END), 6) AS pct FROM (SELECT ticker, session, close, month(session) AS mth FROM $bars) a JOIN (SELECT ticker, session, close, month(session) AS mth FROM $bars) b ON a.ticker = b.ticker AND a.mth = b.mth AND b.session < a.session GROUP BY a.ticker, a.session HAVING count(*) >= 8")


def w38_phased_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of each session, averaged over every fifth session in five phases."""
    f = _features(spark, sf_dir).where("cl IS NOT NULL AND fwd IS NOT NULL").select("session", "cl", "fwd")
    mean_rank = lambda c: F.rank().over(Window.partitionBy("session").orderBy(c)) + (F.count("*").over(Window.partitionBy("session", c)) - 1) / 2
    by_session = f.select("session", mean_rank("cl").alias("a"), mean_rank("fwd").alias("b")).groupBy("session").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("ic"))
    numbered = order.numbered_sessions(by_session)
    return by_session.where("n >= 5").join(numbered, "session").groupBy((F.col("number") % 5).cast("long").alias("phase")).agg(F.round(F.avg("ic"), 6).alias("ic"))


W38_SQL = Q(
    "WITH r AS (SELECT session, (dense_rank() OVER (ORDER BY session) - 1) % 5 AS phase, (rank() OVER (PARTITION BY session ORDER BY cl) + (count(*) OVER (PARTITION BY session, cl) - 1) / 2D) AS a, (rank() OVER (PARTITION BY session ORDER BY fwd) + (count(*) OVER (PARTITION BY session, fwd) - 1) / 2D) AS b FROM $features WHERE cl IS NOT NULL AND fwd IS NOT NULL) "
    "SELECT phase, round(avg(ic), 6) AS ic FROM (SELECT session, phase, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM r GROUP BY session, phase HAVING count(*) >= 5) t GROUP BY phase"
)


def m03_purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts of the calendar, the last four tested: each fold's test rows and purged training rows by ticker."""
    rows = _features(spark, sf_dir).select("ticker", "session", F.when(F.col("fwd").isNotNull(), F.col("label_end")).alias("label_end"))
    got = folds.purged_folds(rows, 5).groupBy("fold", "role", "ticker").agg(F.count("*").alias("n"), F.min("session").alias("first"), F.max("label_end").alias("last_end"))
    return got.select("fold", "role", "ticker", "n", F.col("first").cast("string").alias("first"), F.col("last_end").cast("string").alias("last_end"))


M03_SQL = Q(
    "WITH u AS (SELECT list(session ORDER BY session) AS d FROM (SELECT DISTINCT session FROM $features)), "
    "e AS (SELECT k AS fold, d[CAST(floor(k * len(d) / 5.0D) AS BIGINT) + 1] AS first_, d[CAST(floor((k + 1) * len(d) / 5.0D) AS BIGINT)] AS last_ FROM u, (SELECT unnest(range(1, 5)) AS k)), "
    "r AS (SELECT ticker, session, label_end FROM $features WHERE fwd IS NOT NULL), "
    "x AS (SELECT fold, 'test' AS role, ticker, session, label_end FROM r, e WHERE session BETWEEN first_ AND last_ UNION ALL SELECT fold, 'train', ticker, session, label_end FROM r, e WHERE label_end < first_) "
    "SELECT fold, role, ticker, count(*) AS n, CAST(min(session) AS STRING) AS first, CAST(max(label_end) AS STRING) AS last_end FROM x GROUP BY fold, role, ticker"
)


def m02_purged_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labelled rows may train a model as of each session."""
    f = _features(spark, sf_dir)
    rows = f.select("session", F.when(F.col("fwd").isNotNull(), F.col("label_end")).alias("label_end"))
    return folds.eligible(rows, f).select(F.col("session").cast("string").alias("session"), "n")


M02_SQL = Q("WITH s AS (SELECT DISTINCT session FROM $features), e AS (SELECT label_end, count(*) AS n FROM $features WHERE fwd IS NOT NULL GROUP BY label_end) SELECT CAST(s.session AS STRING) AS session, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS n FROM s LEFT JOIN e ON e.label_end < s.session GROUP BY s.session")


def j18_next_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first session after each order's day, however far; null where none follows.

    Days and sessions, a row each, are put in one order; orders join by day.
    """
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    sessions = B.index_bars(spark, sf_dir).select(F.col("session").alias("day"), F.col("session").alias("next"))
    both = sessions.unionByName(orders.select("day").distinct().withColumn("next", F.lit(None).cast("date")))
    later = Window.orderBy("day", F.col("next").isNull()).rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("next_session", F.min("next").over(later)).where("next IS NULL").select("day", "next_session")
    return orders.join(found, "day").select("o_orderkey", F.col("next_session").cast("string").alias("next_session"))


J18_SQL = Q("SELECT o_orderkey, CAST((SELECT min(m.session) FROM $market m WHERE m.session > CAST(o.o_orderdate AS DATE)) AS STRING) AS next_session FROM $orders o")


QUERIES = {
    "a14_roc_auc": a14_roc_auc,
    "a17_quintile_means": a17_quintile_means,
    "w35_strict_past_percentile": w35_strict_past_percentile,
    "w38_phased_ic": w38_phased_ic,
    "m02_purged_training": m02_purged_training,
    "m03_purged_folds": m03_purged_folds,
    "j18_next_session": j18_next_session,
}
ORACLE_SQL = {
    "a14_roc_auc": A14_SQL,
    "a17_quintile_means": A17_SQL,
    "w35_strict_past_percentile": W35_SQL,
    "w38_phased_ic": W38_SQL,
    "m02_purged_training": M02_SQL,
    "m03_purged_folds": M03_SQL,
    "j18_next_session": J18_SQL,
}
