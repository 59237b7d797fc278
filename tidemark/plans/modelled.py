"""Queries over quantile heads, boundaries, factors, frozen artifacts, assignment intervals and scenario paths, with SQL written apart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import assignments, decision, factors, folds, frozen, order, scenarios, state, tails
from tidemark.operators import layers as L
from tidemark.plans import layered, relational, stateful
from tidemark.sources import bars as B
from tidemark.sources import batches, storage
from tidemark.streaming import processors, trades

Q = relational.duck_sql
SHARES = [0.1, 0.5, 0.9]
HEADS = ["vr", "cl", "rel_20"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stack(layered.base(spark, sf_dir, "week", True), relational.FEATURES)


def streamed(rows: DataFrame, work: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What `work` makes of rows read as a stream, a file a batch: its output is written as Parquet, batch by batch, and read."""
    spark = rows.sparkSession
    root = f"{storage.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, processors.ROCKSDB)
    try:
        made = work(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
        schema = made.schema
        sink = lambda out, batch: out.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
        query = made.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(schema).parquet(f"{root}/out").drop("batch")


def in_batches(frames: list[DataFrame], take: Callable[[DataFrame, int], None]) -> None:
    """Streams the frames, a file and so a batch each, in their order."""
    spark = frames[0].sparkSession
    root = f"{storage.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(f"{root}/in")
    query = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in").writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()


def m08_quantile_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower, median and upper quantiles of the forward return, fitted on purged folds: coverage and loss of each fold's test rows."""
    f = _features(spark, sf_dir).select("ticker", "session", "label_end", "vr", "cl", F.least("rel_20", F.lit(5.0)).alias("rel_20"), F.least("fwd", F.lit(1.0)).alias("fwd"))
    rows = folds.purged_folds(f.where("fwd IS NOT NULL"), 5)
    heads = tails.quantile_heads(rows.where("role = 'train'"), HEADS, "fwd", SHARES, ["fold"], rounds=20)
    test = tails.quantile_predictions(rows.where("role = 'test'"), heads, HEADS, ["fold"]).where("quantiles IS NOT NULL")
    each = test.select("fold", "fwd", F.explode("quantiles").alias("q")).select("fold", "fwd", "q.share", "q.value")
    out = each.groupBy("fold", "share").agg(F.count("*").alias("n"), F.avg((F.col("fwd") <= F.col("value")).cast("double")).alias("below"), F.avg(tails.pinball(F.col("fwd"), F.col("value"), F.col("share"))).alias("loss"))
    return out.select("fold", "share", "n", F.round("below", 3).alias("below"), F.round("loss", 5).alias("loss"))


def m08b_tail_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries over scores made of features by rule, for each group of tickers."""
    f = _features(spark, sf_dir).join(B.groups(spark, sf_dir), "ticker")
    rows = f.selectExpr(
        "grp", "vr / 2 AS down_probability", "0.02D * cl - 0.001D AS median_return", "0.02D * cl - 0.055D AS lower_return", "(cl + 1) / 4 AS rebound_probability",
        "CASE WHEN tail_down THEN 1D WHEN NOT tail_down THEN 0D END AS down_event", "least(fwd, 1D) AS terminal_return",
    )
    got = tails.tail_boundary(rows, minimum=20, by=["grp"])
    shown = [F.round(c, 6).alias(c) for c in ("coverage", "down_precision", "mean_terminal_return")]
    return got.select("grp", "down_threshold", "rebound_cap", "n", "risk_count", *shown, "status", F.array_join("reasons", ",").alias("reasons"), "chosen")


M08B_SQL = Q(
    "WITH r AS (SELECT g.grp, vr / 2 AS d, 0.02D * cl - 0.001D AS m, 0.02D * cl - 0.055D AS lo, (cl + 1) / 4 AS rb, CASE WHEN tail_down THEN 1D ELSE 0D END AS y, least(fwd, 1D) AS ret FROM $features f JOIN $groups g ON f.ticker = g.ticker WHERE vr IS NOT NULL AND cl IS NOT NULL AND tail_down IS NOT NULL AND fwd IS NOT NULL), "
    "b AS (SELECT t, c FROM (VALUES (0.4D), (0.5D), (0.6D)) a(t), (VALUES (0.2D), (0.3D)) e(c)), "
    "s AS (SELECT grp, t, c, count(*) AS n, count(*) FILTER (d >= t AND m < 0 AND lo <= -0.05D AND rb <= c) AS k, avg(y) FILTER (d >= t AND m < 0 AND lo <= -0.05D AND rb <= c) AS p, avg(ret) FILTER (d >= t AND m < 0 AND lo <= -0.05D AND rb <= c) AS mr FROM r, b GROUP BY grp, t, c), "
    "w AS (SELECT *, concat_ws(',', CASE WHEN k < 20 THEN 'insufficient_risk_rows' END, CASE WHEN CAST(k AS DOUBLE) / n < 0.05D THEN 'insufficient_risk_coverage' END, CASE WHEN CAST(k AS DOUBLE) / n > 0.3D THEN 'excessive_risk_coverage' END, CASE WHEN mr IS NULL OR mr >= 0 THEN 'non_negative_risk_return' END) AS reasons FROM s) "
    "SELECT grp, t AS down_threshold, c AS rebound_cap, n, k AS risk_count, round(CAST(k AS DOUBLE) / n, 6) AS coverage, round(p, 6) AS down_precision, round(mr, 6) AS mean_terminal_return, CASE WHEN reasons = '' THEN 'eligible' ELSE 'rejected' END AS status, reasons, "
    "reasons = '' AND row_number() OVER (PARTITION BY grp, reasons = '' ORDER BY p DESC, t DESC, c) = 1 AS chosen FROM w"
)


def a16_score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of rises and the exact median of forward returns by bucket of close location."""
    f = _features(spark, sf_dir).where("cl IS NOT NULL AND fwd IS NOT NULL").selectExpr("CASE WHEN cl < -0.5 THEN 0 WHEN cl < 0 THEN 1 WHEN cl < 0.5 THEN 2 ELSE 3 END AS bucket", "fwd")
    middle = order.exact_quantiles(f, ["fwd"], [0.5], ["bucket"]).select("bucket", F.round("value", 6).alias("median_fwd"))
    return f.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg((F.col("fwd") > 0).cast("double")), 6).alias("up_rate")).join(middle, "bucket")


def a19_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two quantiles of each ticker's returns, and of each group's, for which one task would be too few."""
    f = _features(spark, sf_dir).where("ret IS NOT NULL").select("ticker", F.least("ret", F.lit(5.0)).alias("ret"))
    f = f.join(B.groups(spark, sf_dir), "ticker").select(F.explode(F.array(F.struct(F.lit("ticker").alias("level"), F.col("ticker").alias("name_")), F.struct(F.lit("group").alias("level"), F.col("grp").cast("string").alias("name_")))).alias("x"), "ret")
    got = order.exact_quantiles(f.select("x.level", F.col("x.name_").alias("member"), "ret"), ["ret"], [0.05, 0.95], ["level", "member"])
    return got.groupBy("level", "member").agg(*(F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 6).alias(n) for s, n in ((0.05, "q05"), (0.95, "q95"))))


A16_SQL = Q("SELECT bucket, count(*) AS n, round(avg(CASE WHEN fwd > 0 THEN 1D ELSE 0D END), 6) AS up_rate, round(median(fwd), 6) AS median_fwd FROM (SELECT CASE WHEN cl < -0.5 THEN 0 WHEN cl < 0 THEN 1 WHEN cl < 0.5 THEN 2 ELSE 3 END AS bucket, fwd FROM $features WHERE cl IS NOT NULL AND fwd IS NOT NULL) t GROUP BY bucket")
A19_SQL = Q(
    "WITH r AS (SELECT f.ticker, CAST(g.grp AS STRING) AS grp, least(ret, 5D) AS ret FROM $features f JOIN $groups g ON f.ticker = g.ticker WHERE ret IS NOT NULL) "
    "SELECT 'ticker' AS level, ticker AS member, round(quantile_cont(ret, 0.05), 6) AS q05, round(quantile_cont(ret, 0.95), 6) AS q95 FROM r GROUP BY ticker UNION ALL SELECT 'group', grp, round(quantile_cont(ret, 0.05), 6), round(quantile_cont(ret, 0.95), 6) FROM r GROUP BY grp"
)

#: Factors whose columns the plain feature frame has, and one that asks for a column that it lacks.
PLAIN = ("close_vs_ema20_pct", "close_vs_sma50_pct", "close_vs_sma200_pct", "mom_3_1", "mom_6_1", "mom_12_1", "pivot_distance_pct", "prior_high_breakout", "volume_ratio", "atr20_pct", "realized_vol_63", "overheat_score")
BROKEN = factors.Factor("broken", "Broken", "legacy", "neutral", "no_such_column + 1", "none")
_OVERHEAT = "least(100D, least(greatest(ext_ma20, 0D) * 2, 30D) + least(greatest(chg_20 * 100, 0D) * 0.8D, 30D) + least(greatest(chg_10 * close / nullif(atr14, 0), 0D) * 4, 25D))"
_OVERHEAT_KNOWN = "ext_ma20 IS NOT NULL AND chg_20 IS NOT NULL AND atr14 IS NOT NULL"


def _factor_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir).join(state.emas(B.bars(spark, sf_dir)).select("ticker", "session", "ema20"), ["ticker", "session"], "left")
    more = [{"mean_volume_20": L.sma("volume", 20), "overheat": f"CASE WHEN {_OVERHEAT_KNOWN} THEN {_OVERHEAT} END", "prior_high_breakout": L.sure(f"close > pivot_close AND {L.lag('close')} <= {L.lag('pivot_close')}")}]
    return L.stack(f.drop("mean_volume_20"), more)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("ticker", F.col("session").cast("string").alias("session"), "key", F.round("raw", 6).alias("raw"), "shown", "missing_reason", "peer_count", F.round("percentile", 6).alias("percentile"), F.round("display_score", 4).alias("display_score"))


def s211_factor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of the plain frame, of which one fails, at the last sessions of each quarter."""
    kept = factors.FactorRegistry([f for f in factors.BUILT_IN if f.key in PLAIN])
    kept.register(BROKEN)
    return _shown(kept.evaluate(_factor_frame(spark, sf_dir)))


def _factor_sql() -> str:
    values = {f.key: f.value for f in factors.BUILT_IN if f.key in PLAIN}
    numbers = [k for k in PLAIN if k != "prior_high_breakout"]
    one = " UNION ALL ".join(f"SELECT ticker, session, '{k}' AS key, CAST({values[k]} AS DOUBLE) AS raw FROM f" for k in numbers)
    lower = ", ".join(f"'{f.key}'" for f in factors.BUILT_IN if f.direction == "lower")
    higher = ", ".join(f"'{f.key}'" for f in factors.BUILT_IN if f.direction == "higher")
    return Q(
        f"WITH f AS (SELECT $features.*, e.ema20, CASE WHEN count(volume) OVER w = 20 THEN avg(volume) OVER w END AS mean_volume_20, CASE WHEN {_OVERHEAT_KNOWN} THEN {_OVERHEAT} END AS overheat, coalesce(close > pivot_close AND lag(close) OVER o <= lag(pivot_close) OVER o, FALSE) AS up "
        "FROM $features LEFT JOIN $emas e USING (ticker, session) WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS 19 PRECEDING), o AS (PARTITION BY ticker ORDER BY session)), "
        f"v AS ({one}), "
        "r AS (SELECT *, count(*) OVER (PARTITION BY key, session) AS n, (rank() OVER (PARTITION BY key, session ORDER BY raw) + (count(*) OVER (PARTITION BY key, session, raw) - 1) / 2D) / count(*) OVER (PARTITION BY key, session) AS pct FROM v WHERE raw IS NOT NULL), "
        f"z AS (SELECT ticker, session, key, raw, CAST(NULL AS VARCHAR) AS shown, CAST(NULL AS VARCHAR) AS missing_reason, n AS peer_count, CASE WHEN n >= 5 THEN pct END AS percentile, CASE WHEN n < 5 THEN NULL WHEN key IN ({higher}) THEN pct * 100 WHEN key IN ({lower}) THEN (1 - pct) * 100 END AS display_score FROM r "
        "UNION ALL SELECT ticker, session, key, NULL, NULL, 'missing_value', NULL, NULL, NULL FROM v WHERE raw IS NULL "
        "UNION ALL SELECT ticker, session, 'prior_high_breakout', NULL, CASE WHEN up THEN 'true' ELSE 'false' END, NULL, NULL, NULL, NULL FROM f "
        "UNION ALL SELECT ticker, session, 'broken', NULL, NULL, 'factor_error', NULL, NULL, NULL FROM f) "
        "SELECT ticker, CAST(session AS STRING) AS session, key, round(raw, 6) AS raw, shown, missing_reason, peer_count, round(percentile, 6) AS percentile, round(display_score, 4) AS display_score FROM z"
    )


def s211_all_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in factors over the frame with swings, contractions, early reversals and the rules' total."""
    f = L.stack(_factor_frame(spark, sf_dir), L.PLATFORM)
    keyed = lambda df: df.withColumn("session", F.to_date("session"))
    parts = [
        keyed(stateful.x06_contractions(spark, sf_dir)).select("ticker", "session", F.col("stage").alias("vcp_stage")),
        keyed(stateful.x04_trendlines(spark, sf_dir)).select("ticker", "session", F.col("breakout").alias("trendline_breakout"), F.col("higher_low").alias("higher_low_confirmed")),
        keyed(relational.QUERIES["x15_early_reversal"](spark, sf_dir)).select("ticker", "session", F.col("score").alias("early_reversal_score")),
        keyed(relational.QUERIES["p17_total_and_grade"](spark, sf_dir)).select("ticker", "session", F.col("total").alias("legacy_score")),
    ]
    for p in parts:
        f = f.join(p, ["ticker", "session"], "left")
    return _shown(factors.FactorRegistry(factors.BUILT_IN).evaluate(f))


#: Evidence by rule: an override now and then, exact and broad codes of the register for some, behaviour seen late.
_EVIDENCE = (
    "SELECT ticker, 'override' AS source, 'theme' AS code, CAST(date_add(DATE '1996-01-01', k * 7) AS DATE) AS effective_from, CAST(date_add(DATE '1996-07-01', k * 9) AS DATE) AS effective_to, DATE '1996-01-01' AS observed_at FROM $tk WHERE k % 2 = 0 "
    "UNION ALL SELECT ticker, 'override', 'theme', CAST(date_add(DATE '1996-07-01', k * 9) AS DATE), CASE WHEN k % 4 = 0 THEN CAST(date_add(DATE '1997-07-01', k) AS DATE) END, DATE '1996-01-01' FROM $tk WHERE k % 2 = 0 "
    "UNION ALL SELECT ticker, 'sec_theme', 'chips', DATE '1994-01-01', DATE '1996-03-01', DATE '1998-01-01' FROM $tk WHERE k % 3 = 0 "
    "UNION ALL SELECT ticker, 'sec_broad', CASE WHEN k % 5 = 0 THEN 'energy' ELSE 'tech' END, CAST(date_add(DATE '1995-01-01', k) AS DATE), NULL, DATE '1998-01-01' FROM $tk WHERE k % 5 <> 1 "
    "UNION ALL SELECT ticker, 'market_behavior', 'cyclical', NULL, NULL, DATE '1997-03-01' FROM $tk WHERE k % 7 <> 3"
)
_TK = "(SELECT ticker, CAST(substring(ticker, 7) AS INT) AS k FROM $groups)"
PRIORITY = ["override", "sec_theme", "sec_broad", "market_behavior"]


def x21b_interval_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals out of four sources of evidence, behaviour not before it was seen, the rest in review."""
    evidence = relational.spark_sql(spark, sf_dir, _EVIDENCE.replace("$tk", _TK))
    members = B.groups(spark, sf_dir).select("ticker", F.lit("1995-03-01").cast("date").alias("history_start"), F.lit("1998-06-01").cast("date").alias("observed"))
    got = assignments.assignment_intervals(evidence, members, PRIORITY, ["market_behavior"])
    return got.select("ticker", *(F.col(c).cast("string").alias(c) for c in ("effective_from", "effective_to")), "source", "code")


X21B_SQL = Q(
    f"WITH tk AS {_TK}, e AS ({_EVIDENCE.replace('$tk', 'tk')}), "
    "s AS (SELECT ticker, source, code, greatest(coalesce(effective_from, DATE '1995-03-01'), DATE '1995-03-01', CASE WHEN source = 'market_behavior' THEN observed_at ELSE DATE '1995-03-01' END) AS f, coalesce(effective_to, DATE '9999-12-31') AS t, CASE source WHEN 'override' THEN 1 WHEN 'sec_theme' THEN 2 WHEN 'sec_broad' THEN 3 ELSE 4 END AS p FROM e), "
    "g AS (SELECT * FROM s WHERE f < t AND f <= DATE '1998-06-01'), "
    "b AS (SELECT ticker, DATE '1995-03-01' AS d FROM tk UNION SELECT ticker, f FROM g UNION SELECT ticker, t FROM g WHERE t <= DATE '1998-06-01'), "
    "n AS (SELECT ticker, d, lead(d) OVER (PARTITION BY ticker ORDER BY d) AS nx FROM b), "
    "w AS (SELECT n.ticker, d, nx, coalesce(arg_min(g.source, g.p), 'review') AS source, arg_min(g.code, g.p) AS code FROM n LEFT JOIN g ON g.ticker = n.ticker AND g.f <= d AND d < g.t GROUP BY n.ticker, d, nx), "
    "i AS (SELECT *, sum(CASE WHEN source IS NOT DISTINCT FROM ps AND code IS NOT DISTINCT FROM pc THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(source) OVER (PARTITION BY ticker ORDER BY d) AS ps, lag(code) OVER (PARTITION BY ticker ORDER BY d) AS pc FROM w)) "
    "SELECT ticker, CAST(min(d) AS STRING) AS effective_from, CASE WHEN bool_or(nx IS NULL) THEN NULL ELSE CAST(max(nx) AS STRING) END AS effective_to, any_value(source) AS source, any_value(code) AS code FROM i GROUP BY ticker, k"
)

#: Three frozen models: features with what stands for a missing one, center, scale and a coefficient for each class.
MODELS = [
    ("ridge-1", "ridge", [("", 0.01, [0.02, -0.03, 0.05])], 0.5, 0.005),
    ("binary-1", "binary_logistic", [("1", -1.0, [0.8, -0.5, 0.3])], 0.3, 0.0),
    ("direction-1", "direction_logistic", [("down", -0.4, [0.6, -0.4, -0.1]), ("neutral", 0.2, [-0.3, 0.0, 0.0]), ("up", -0.3, [0.1, 0.5, 0.2])], 0.5, 0.02),
]
FROZEN = {"vr": (1.0, 1.1, 0.5), "cl": (0.0, 0.05, 0.6), "rel_20": (0.0, 0.02, 0.8)}


def _artifacts(spark: SparkSession) -> DataFrame:
    rows = [(v, kind, c, f, *FROZEN[f], w, b, threshold, band) for v, kind, heads, threshold, band in MODELS for c, b, weights in heads for f, w in zip(FROZEN, weights)]
    return spark.createDataFrame(rows, frozen.ARTIFACT)


def m11_frozen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frozen models over all features at once."""
    got = frozen.score(_features(spark, sf_dir), _artifacts(spark), ["ticker", "session"])
    return got.select("ticker", F.col("session").cast("string").alias("session"), "version", "predicted_event", F.round("predicted_score", 6).alias("predicted_score"), "predicted_direction", F.round("predicted_return", 6).alias("predicted_return"))


def _logit(intercept: float, weights: list[float]) -> str:
    return f"{intercept!r}D + " + " + ".join(f"{w!r}D * ((coalesce({f}, {i!r}D) - {c!r}D) / {s!r}D)" for w, (f, (i, c, s)) in zip(weights, FROZEN.items()))


def _m11_sql() -> str:
    (_, _, [(_, rb, rw)], _, band), (_, _, [(_, bb, bw)], threshold, _), (_, _, heads, _, _) = MODELS
    p = lambda x: f"1 / (1 + exp(-least(greatest({x}, -35D), 35D)))"
    d, n, u = (p(_logit(b, w)) for _, b, w in heads)
    return Q(
        f"WITH s AS (SELECT ticker, CAST(session AS STRING) AS session, {_logit(rb, rw)} AS r, {p(_logit(bb, bw))} AS b, {d} AS d, {n} AS n, {u} AS u FROM $features) "
        f"SELECT ticker, session, 'ridge-1' AS version, r < -{band}D AS predicted_event, round(-r, 6) AS predicted_score, CASE WHEN r < -{band}D THEN 'down' WHEN r > {band}D THEN 'up' ELSE 'neutral' END AS predicted_direction, round(r, 6) AS predicted_return FROM s "
        f"UNION ALL SELECT ticker, session, 'binary-1', b >= {threshold}D, round(b, 6), CASE WHEN b >= {threshold}D THEN 'down' ELSE 'not_down' END, NULL FROM s "
        "UNION ALL SELECT ticker, session, 'direction-1', d >= n AND d >= u, round(d / (d + n + u), 6), CASE WHEN d >= n AND d >= u THEN 'down' WHEN n >= u THEN 'neutral' ELSE 'up' END, NULL FROM s"
    )


def a35_scenario_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scenarios.scenario_bands(B.bars(spark, sf_dir))
    return got.select("ticker", "horizon", F.col("observation_date").cast("string").alias("observation_date"), "sample_count", "missing_reason", *(F.round(c, 6).alias(c) for c in ("observation_close", "realized_vol_63", "return_cap", *scenarios.NAMES)))


def a35_scenario_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scenarios.scenario_paths(scenarios.scenario_bands(B.bars(spark, sf_dir)))
    return got.select("ticker", "horizon", "scenario", "step", F.round("return", 6).alias("growth"), F.round("price", 4).alias("price"))


_BANDS = (
    "WITH b AS (SELECT ticker, session, close, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) - 1 AS back, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS r1 FROM $bars), "
    "h AS (SELECT unnest([20, 40, 60])::BIGINT AS horizon), "
    "s AS (SELECT a.ticker, horizon, a.close / c.close - 1 AS r FROM b a JOIN h ON a.back % horizon = 0 JOIN b c ON c.ticker = a.ticker AND c.back = a.back + horizon), "
    "q AS (SELECT ticker, horizon, count(*) AS n, quantile_cont(r, [0.25, 0.5, 0.75]) AS q FROM s GROUP BY ticker, horizon), "
    "t AS (SELECT ticker, max(session) AS day, arg_max(close, session) AS close, stddev_samp(r1) FILTER (back < 63) * sqrt(252D) AS vol FROM b GROUP BY ticker), "
    "z AS (SELECT t.ticker, h.horizon, day, close, coalesce(n, 0) AS n, q, vol, 3 * vol * sqrt(h.horizon / 252D) AS cap FROM t CROSS JOIN h LEFT JOIN q ON q.ticker = t.ticker AND q.horizon = h.horizon), "
    "m AS (SELECT *, n >= 8 AS ok, greatest(least(q[1], cap), -cap) AS p, greatest(least(q[2], cap), -cap) AS med, greatest(least(q[3], cap), -cap) AS o FROM z) "
)
A35_SQL = Q(_BANDS + "SELECT ticker, horizon, CAST(day AS STRING) AS observation_date, n AS sample_count, CASE WHEN NOT ok THEN 'insufficient_samples' END AS missing_reason, round(close, 6) AS observation_close, CASE WHEN ok THEN round(vol, 6) END AS realized_vol_63, CASE WHEN ok THEN round(cap, 6) END AS return_cap, CASE WHEN ok THEN round(p, 6) END AS pessimistic, CASE WHEN ok THEN round(med, 6) END AS median, CASE WHEN ok THEN round(o, 6) END AS optimistic FROM m")
A35_PATHS_SQL = Q(
    _BANDS + "SELECT ticker, horizon, scenario, step, round((1 + g) ** (CAST(step AS DOUBLE) / horizon) - 1, 6) AS growth, round(close * (1 + g) ** (CAST(step AS DOUBLE) / horizon), 4) AS price FROM "
    "(SELECT ticker, horizon, close, 'pessimistic' AS scenario, p AS g FROM m WHERE ok UNION ALL SELECT ticker, horizon, close, 'median', med FROM m WHERE ok UNION ALL SELECT ticker, horizon, close, 'optimistic', o FROM m WHERE ok) x JOIN (SELECT unnest(range(61)) AS step) k ON step <= horizon"
)


#: What the decision reads, made of features by rule.
_DECIDED = """SELECT ticker, session, CASE WHEN chg_20 IS NULL THEN 'unavailable' WHEN chg_20 > 0.01 THEN 'up' WHEN chg_20 < -0.01 THEN 'down' ELSE 'neutral' END AS raw_direction,
  CASE WHEN distribution THEN 25D ELSE 0D END + CASE WHEN close < sma20 THEN 20D ELSE 0D END + CASE WHEN vr >= 1.5 THEN 20D ELSE 0D END + CASE WHEN cl <= -0.6 THEN 10D ELSE 0D END AS immediate_score, pos > 30 AS known,
  CASE WHEN chg_5 IS NOT NULL THEN least(100D, greatest(0D, -60 * chg_5)) END AS individual_score, CASE WHEN rel_20 IS NOT NULL AND pos % 3 > 0 THEN least(100D, greatest(0D, -90 * rel_20)) END AS group_score,
  CASE WHEN chg_60 IS NOT NULL AND pos % 4 > 0 THEN least(100D, greatest(0D, -100 * chg_60)) END AS slow_decline_score, CASE WHEN vr IS NULL THEN 0D ELSE least(100D, 15 * vr) END AS score,
  CASE WHEN off_high >= -0.2 AND distribution_10 >= 2 THEN 'confirmed' WHEN off_high >= -0.2 AND distribution_5 >= 1 THEN 'fading' ELSE 'low' END AS top_state, CASE WHEN ret < 0 THEN 'confirmed' ELSE 'high' END AS top_raw_state FROM $features"""


def p21b_decision_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six steps of the ladder over scores made of features."""
    rows = relational.spark_sql(spark, sf_dir, _DECIDED)
    names = F.array_compact(F.array(*(F.when(F.col(f"{n}_score") >= low, n) for n, low in (("individual", 20), ("group", 40), ("slow_decline", 50)))))
    got = decision.decide(rows.withColumn("sources", names))
    return got.select("ticker", F.col("session").cast("string").alias("session"), "raw_direction", "risk_state", "final_direction", "action", F.array_join("reasons", ",").alias("reasons"))


P21B_SQL = Q(
    f"WITH d AS ({_DECIDED}), "
    "l AS (SELECT *, CASE WHEN NOT known THEN 'unavailable' WHEN individual_score IS NULL AND group_score IS NULL AND slow_decline_score IS NULL THEN CASE WHEN score >= 30 THEN 'high' WHEN score >= 20 THEN 'watch' ELSE 'low' END "
    "WHEN individual_score >= 30 OR group_score >= 60 OR slow_decline_score >= 70 THEN 'high' WHEN individual_score >= 20 OR group_score >= 40 OR slow_decline_score >= 50 THEN 'watch' ELSE 'low' END AS lv FROM d), "
    "s AS (SELECT *, CASE WHEN immediate_score >= 70 THEN 1 WHEN known AND top_state = 'confirmed' AND top_raw_state = 'confirmed' THEN 2 WHEN lv = 'high' AND immediate_score >= 40 THEN 3 WHEN lv = 'high' THEN 4 WHEN known AND top_state IN ('confirmed', 'fading', 'high') THEN 5 WHEN lv = 'watch' THEN 6 ELSE 7 END AS k FROM l), "
    "f AS (SELECT *, CASE WHEN k <= 3 THEN 'down' WHEN k <= 5 AND raw_direction = 'up' THEN 'neutral' ELSE raw_direction END AS fd, concat_ws(',', CASE k WHEN 1 THEN 'immediate_bearish_confirmation' WHEN 2 THEN 'high_level_distribution_risk,high_level_structure_damage_confirmation' WHEN 3 THEN 'persistent_bearish_risk,persistent_immediate_confluence' WHEN 4 THEN 'persistent_bearish_risk' WHEN 5 THEN 'high_level_distribution_risk' WHEN 6 THEN 'persistent_bearish_risk' END, "
    "CASE WHEN k <= 6 AND known AND individual_score >= 20 THEN 'individual_bearish_risk' END, CASE WHEN k <= 6 AND known AND group_score >= 40 THEN 'group_bearish_risk' END, CASE WHEN k <= 6 AND known AND slow_decline_score >= 50 THEN 'slow_decline_bearish_risk' END) AS why FROM s) "
    "SELECT ticker, CAST(session AS STRING) AS session, raw_direction, CASE WHEN raw_direction = 'unavailable' THEN NULL WHEN k <= 3 THEN 'confirmed' WHEN k <= 5 THEN 'high' WHEN k = 6 THEN 'watch' WHEN known THEN 'low' ELSE 'unavailable' END AS risk_state, CASE WHEN raw_direction = 'unavailable' THEN raw_direction ELSE fd END AS final_direction, "
    "CASE WHEN raw_direction = 'unavailable' OR fd = raw_direction THEN 'retain' WHEN fd = 'neutral' THEN 'downgrade_to_neutral' ELSE 'override_to_down' END AS action, CASE WHEN raw_direction = 'unavailable' THEN '' ELSE why END AS reasons FROM f"
)


def r06b_trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five minutes, an hour and a trading day up to each symbol's newest trade, with volumes by direction."""
    directed = storage.cut(trades.directions(B.market_events(spark, sf_dir), 3_600_000_000_000))
    parts = [trades.trailing(directed, m).withColumn("minutes", F.lit(m).cast("long")) for m in (5, 60, 390)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("symbol", "minutes", "trades", "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "unknown_volume", "delta", F.round("pressure", 4).alias("pressure"), F.round("coverage", 6).alias("coverage"))


R06B_SQL = f"""
WITH d AS ({stateful.R02_SQL}), t AS (SELECT e.symbol, e.event_id, e.ns, e.price, e.size::DOUBLE AS size, d.direction FROM ({B.MARKET_EVENTS_SQL}) e JOIN d ON d.symbol = e.symbol AND d.event_id = e.event_id WHERE e.kind = 'trade'),
n AS (SELECT symbol, max(ns) AS newest FROM t GROUP BY symbol),
r AS (SELECT t.*, minutes FROM t JOIN n USING (symbol) JOIN (SELECT unnest([5, 60, 390])::BIGINT AS minutes) m ON ns >= newest - minutes * 60000000000 WHERE ns // 86400000000000 = newest // 86400000000000),
a AS (SELECT symbol, minutes, count(*) AS trades, arg_min(price, (ns, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ns, event_id)) AS close, sum(size) AS volume,
  coalesce(sum(size) FILTER (direction = 'buy'), 0) AS buy_volume, coalesce(sum(size) FILTER (direction = 'sell'), 0) AS sell_volume, coalesce(sum(size) FILTER (direction = 'unknown'), 0) AS unknown_volume FROM r GROUP BY symbol, minutes)
SELECT *, buy_volume - sell_volume AS delta, round(100 * (buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0), 4) AS pressure, round((buy_volume + sell_volume) / nullif(volume, 0), 6) AS coverage FROM a"""


def r04b_effective_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effective trades again, by a stream of the events in several batches in any order, through state and retractions."""
    events = stateful._numbered(B.market_events(spark, sf_dir))
    own = events.where("kind = 'trade'").select(F.col("symbol").cast("string").alias("symbol"), "kind", "event_id", F.lit(None).cast("long").alias("old_id"), F.lit(None).cast("long").alias("new_id"), "ns", "price", F.col("size").cast("double").alias("size"))
    changes = stateful._changes(events).select(F.col("symbol").cast("string").alias("symbol"), F.when(F.col("new_id").isNull(), "cancel").otherwise("correction").alias("kind"), F.lit(None).cast("long").alias("event_id"), "old_id", "new_id", F.lit(0).cast("long").alias("ns"), "price", F.lit(0.0).alias("size"))
    log = streamed(own.unionByName(changes).repartition(4, F.xxhash64("event_id", "old_id")), processors.effective_stream, "effective")
    now = processors.effective_now(log)
    return now.select(F.col("symbol").cast("long").alias("symbol"), "event_id", "price", F.col("replaced_by").cast("double").alias("replaced_by"))


STALE, GONE = 6 * 3_600_000, 24 * 3_600_000


def r12b_liveness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each symbol is left in by a stream of events: stale six hours after its last event by the watermark, disconnected a day later."""
    events = B.market_events(spark, sf_dir).select(F.col("symbol").cast("string").alias("symbol"), "kind", "event_ts")
    log = streamed(events.repartition(1), lambda e: processors.liveness_stream(e, STALE, GONE, "1 second"), "liveness")
    last = log.groupBy("symbol").agg(F.max_by(F.struct("state", "at_ms"), F.struct("at_ms", F.when(F.col("state") == "live", 0).when(F.col("state") == "stale", 1).otherwise(2))).alias("r"))
    return last.select(F.col("symbol").cast("long").alias("symbol"), "r.state", "r.at_ms")


R12B_SQL = f"""
WITH e AS (SELECT symbol, max(epoch_us(event_ts) // 1000) AS seen FROM ({B.MARKET_EVENTS_SQL}) GROUP BY symbol), w AS (SELECT max(seen) - 1000 AS w FROM e)
SELECT symbol, CASE WHEN seen + {STALE + GONE} <= w THEN 'disconnected' WHEN seen + {STALE} <= w THEN 'stale' ELSE 'live' END AS state,
  seen + CASE WHEN seen + {STALE + GONE} <= w THEN {STALE + GONE} WHEN seen + {STALE} <= w THEN {STALE} ELSE 0 END AS at_ms FROM e, w"""


def k01b_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' upsert by a stream of three batches into a table with a ledger; each batch is offered twice."""
    old = B.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("batch"))
    moved = F.when(F.col("c_acctbal") < 0, 10_000_000).otherwise(0)
    new = old.where("c_acctbal < 1000").select((F.col("c_custkey") + moved).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("batch"))
    again = new.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") - 50).alias("c_acctbal"), F.lit(2).alias("batch"))
    table = batches.BatchTable(spark, f"{storage.shared_dir(spark)}/upserts-{uuid.uuid4().hex}", T.StructType.fromDDL("c_custkey long, c_acctbal double"), ["c_custkey"], 8)
    take = table.upsert("batch")

    def twice(rows: DataFrame, batch: int) -> None:
        take(rows, batch)
        take(rows, batch)

    in_batches([old, new, again], twice)
    return table.read().select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


QUERIES = {
    "m08_quantile_heads": m08_quantile_heads,
    "m08b_tail_boundary": m08b_tail_boundary,
    "a16_score_buckets": a16_score_buckets,
    "a19_exact_quantiles": a19_exact_quantiles,
    "s211_factor_registry": s211_factor_registry,
    "s211_all_factors": s211_all_factors,
    "x21b_interval_sweep": x21b_interval_sweep,
    "m11_frozen_scores": m11_frozen_scores,
    "a35_scenario_bands": a35_scenario_bands,
    "a35_scenario_paths": a35_scenario_paths,
    "p21b_decision_policy": p21b_decision_policy,
    "r06b_trailing_windows": r06b_trailing_windows,
    "r04b_effective_stream": r04b_effective_stream,
    "r12b_liveness_stream": r12b_liveness_stream,
    "k01b_stream_upsert": k01b_stream_upsert,
}
ORACLE_SQL = {
    "m08b_tail_boundary": M08B_SQL,
    "a16_score_buckets": A16_SQL,
    "a19_exact_quantiles": A19_SQL,
    "s211_factor_registry": _factor_sql(),
    "x21b_interval_sweep": X21B_SQL,
    "m11_frozen_scores": _m11_sql(),
    "a35_scenario_bands": A35_SQL,
    "a35_scenario_paths": A35_PATHS_SQL,
    "p21b_decision_policy": P21B_SQL,
    "r06b_trailing_windows": R06B_SQL,
    "r04b_effective_stream": stateful.R04_SQL,
    "r12b_liveness_stream": R12B_SQL,
    "k01b_stream_upsert": stateful.K01_SQL,
}
