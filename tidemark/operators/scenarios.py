"""Scenarios from a ticker's own past: quartiles of returns that don't overlap, capped by its volatility, and paths to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples needed, sessions of the volatility, sessions of a year, deviations of the cap.
LEAST_SAMPLES, VOLATILITY_SESSIONS, YEAR, CAP = 8, 63, 252, 3.0
NAMES = ("pessimistic", "median", "optimistic")


def scenario_bands(bars: DataFrame, horizons: tuple[int, ...] = (20, 40, 60), quantiles: tuple[float, float, float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """ticker, horizon, observation_date, observation_close, sample_count, realized_vol_63, return_cap, missing_reason and the three quantiles.

    bars: ticker, session, close, as far as they are known. Samples go back from the last session in steps of the horizon. A history with a
    close that is null, not finite or not positive is invalid as a whole; under 8 samples there is no band. Quantiles are linear
    between neighbours and cut off at three standard deviations of the last 63 returns, scaled to the horizon. A task holds one ticker's
    history, which the calendar bounds.
    """
    order = Window.partitionBy("ticker").orderBy("session")
    back = Window.partitionBy("ticker").orderBy(F.desc("session"))
    sound = F.coalesce((F.col("close") > 0) & (F.col("close") < float("inf")), F.lit(False))
    rows = bars.select("ticker", "session", "close", (F.row_number().over(back) - 1).alias("back"), F.when(sound, 0).otherwise(1).alias("bad"), *((F.col("close") / F.nullif(F.lag("close", h).over(order), F.lit(0.0)) - 1).alias(f"r{h}") for h in (1, *(h for h in horizons if h != 1))))
    whole = rows.groupBy("ticker").agg(F.max("session").alias("observation_date"), F.max_by("close", "session").alias("observation_close"), F.sum("bad").alias("bad"), (F.stddev_samp(F.when(F.col("back") < VOLATILITY_SESSIONS, F.col("r1"))) * F.sqrt(F.lit(float(YEAR)))).alias("vol"), *(F.filter(F.collect_list(F.when(F.col("back") % h == 0, F.col(f"r{h}"))), lambda x: x.isNotNull()).alias(f"s{h}") for h in horizons))
    long = whole.select("ticker", "observation_date", "observation_close", "bad", "vol", F.explode(F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.array_sort(f"s{h}").alias("s")) for h in horizons))).alias("x")).select("*", "x.horizon", "x.s").drop("x")
    n = F.size("s")
    reason = F.when(F.col("bad") > 0, "invalid_close_history").when(n < LEAST_SAMPLES, "insufficient_samples")
    ok = reason.isNull()
    cap = CAP * F.col("vol") * F.sqrt(F.col("horizon") / float(YEAR))

    def quantile(q: float):
        at = (n - 1) * q
        low = F.element_at("s", F.floor(at).cast("int") + 1)
        return low + (F.element_at("s", F.ceil(at).cast("int") + 1) - low) * (at - F.floor(at))

    made = [F.when(ok, F.greatest(F.least(quantile(q), cap), -cap)).alias(name) for name, q in zip(NAMES, quantiles)]
    return long.select("ticker", "horizon", "observation_date", F.when(F.col("bad") == 0, F.col("observation_close")).alias("observation_close"), F.when(F.col("bad") == 0, n).otherwise(0).cast("long").alias("sample_count"), F.when(ok, F.col("vol")).alias("realized_vol_63"), F.when(ok, cap).alias("return_cap"), reason.alias("missing_reason"), *made)


def scenario_paths(bands: DataFrame) -> DataFrame:
    """ticker, horizon, scenario, step (0 to the horizon), return and price: each band's quantiles as paths of constant growth."""
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.col(n).alias("q")) for n in NAMES))).alias("x")
    rows = bands.where("missing_reason IS NULL").select("ticker", "horizon", "observation_close", one).select("ticker", "horizon", "observation_close", "x.scenario", F.log1p("x.q").alias("g"))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("horizon"))))
    share = F.col("g") * F.col("step") / F.col("horizon")
    return rows.select("ticker", "horizon", "scenario", "step", F.expm1(share).alias("return"), (F.col("observation_close") * F.exp(share)).alias("price"))
