"""A registry of factors: named expressions over a feature frame, each judged apart, ranked against the tickers of its session."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Percentiles need so many tickers with a value.
LEAST_PEERS = 5


@dataclass(frozen=True)
class Factor:
    """value: SQL over the frame's columns. direction: higher or lower is better, or neutral. Text and flags are shown but not ranked."""

    key: str
    label: str
    group: str
    direction: str
    value: str
    window: str
    ranked: bool = True
    version: str = "1"

    def __post_init__(self):
        if self.direction not in ("higher", "lower", "neutral"):
            raise ValueError(f"{self.key}: direction {self.direction}")


class FactorRegistry:
    """Factors in order of registration; a key is registered once."""

    def __init__(self, factors: Iterable[Factor] = ()):
        self.factors: dict[str, Factor] = {}
        for f in factors:
            self.register(f)

    def register(self, factor: Factor) -> Factor:
        if factor.key in self.factors:
            raise ValueError(f"factor {factor.key} is registered already")
        self.factors[factor.key] = factor
        return factor

    def evaluate(self, rows: DataFrame, by: tuple[str, str] = ("ticker", "session")) -> DataFrame:
        """A row for each of rows' rows and each factor: key, label, group, direction, version, raw, shown, missing_reason, peer_count, percentile and display_score.

        Each expression is analysed alone against rows; one that fails, for a lacking column say, is missing with reason
        factor_error in every row, and the others are as they were. An expression's own errors at run time are the caller's to
        guard (nullif, try_ functions). raw is the number, null for flags and text, which `shown` has. A value that is null or NaN
        is missing_value. Percentiles are mean ranks over the finite numbers of a session, from 5 tickers on, so a task's window is a
        session's tickers; the display score is 0 to 100 in the factor's direction and null for neutral ones. All factors of all
        sessions are one exchange.
        """
        made = []
        for f in self.factors.values():
            error, value = "factor_error", F.lit(None)
            try:
                kind = rows.select(F.expr(f.value).alias("v")).schema["v"].dataType.simpleString()
                error, value = None, F.expr(f.value)
            except AnalysisException:
                kind = "void"
            number = kind not in ("boolean", "string", "void") and not kind.startswith(("date", "timestamp"))
            raw = value.cast("double") if number else F.lit(None).cast("double")
            made.append(
                F.struct(
                    *(F.lit(x).alias(n) for n, x in (("key", f.key), ("label", f.label), ("group", f.group), ("direction", f.direction), ("version", f.version))),
                    raw.alias("raw"),
                    (F.lit(None) if number else value).cast("string").alias("shown"),
                    F.lit(error).cast("string").alias("error"),
                    F.lit(f.ranked and number).alias("ranked"),
                )
            )
        ticker, session = by
        long = rows.select(ticker, session, F.explode(F.array(*made)).alias("f")).select(ticker, session, "f.*")
        lacking = (F.col("raw").isNull() | F.isnan("raw")) & F.col("shown").isNull()
        ranks = F.col("ranked") & (F.abs("raw") < float("inf"))
        long = long.withColumn("missing_reason", F.when(F.col("error").isNotNull(), F.col("error")).when(lacking, "missing_value")).withColumn("__x", F.when(F.coalesce(ranks, F.lit(False)), F.col("raw")))
        peers = Window.partitionBy("key", session)
        place = F.rank().over(peers.orderBy("__x")) - F.count_if(F.col("__x").isNull()).over(peers) + (F.count("__x").over(Window.partitionBy("key", session, "__x")) - 1) / 2
        n = F.count("__x").over(peers)
        out = long.withColumn("peer_count", F.when(F.col("__x").isNotNull(), n)).withColumn("percentile", F.when(F.col("__x").isNotNull() & (n >= LEAST_PEERS), place / n))
        score = F.when(F.col("direction") == "higher", F.col("percentile") * 100).when(F.col("direction") == "lower", (1 - F.col("percentile")) * 100)
        return out.select(ticker, session, "key", "label", "group", "direction", "version", F.when(~F.isnan("raw"), F.col("raw")).alias("raw"), "shown", "missing_reason", "peer_count", "percentile", score.alias("display_score"))


#: The built-in factors: fixed keys, groups and directions; values over the columns of the feature layers.
BUILT_IN = (
    Factor("close_vs_ema20_pct", "Close vs EMA20", "trend", "higher", "(close / nullif(ema20, 0) - 1) * 100", "20 sessions"),
    Factor("close_vs_sma50_pct", "Close vs SMA50", "trend", "higher", "(close / nullif(sma50, 0) - 1) * 100", "50 sessions"),
    Factor("close_vs_sma200_pct", "Close vs SMA200", "trend", "higher", "(close / nullif(sma200, 0) - 1) * 100", "200 sessions"),
    Factor("mom_3_1", "3-1 month momentum", "momentum", "higher", "mom_63", "63 sessions but the last 21"),
    Factor("mom_6_1", "6-1 month momentum", "momentum", "higher", "mom_126", "126 sessions but the last 21"),
    Factor("mom_12_1", "12-1 month momentum", "momentum", "higher", "mom_252", "252 sessions but the last 21"),
    Factor("strict_vcp", "Contractions", "structure", "neutral", "vcp_stage", "up to 250 sessions"),
    Factor("tight_platform", "Tight platform", "structure", "neutral", "CASE WHEN tight_platform THEN 'Detected' ELSE 'Rejected' END", "20 sessions"),
    Factor("pivot_distance_pct", "Distance to pivot", "structure", "neutral", "over_pivot", "20 sessions before"),
    Factor("prior_high_breakout", "Prior-high breakout", "structure", "neutral", "prior_high_breakout", "20 sessions before"),
    Factor("trendline_breakout", "Trendline breakout", "structure", "neutral", "trendline_breakout", "confirmed swings"),
    Factor("higher_low_confirmed", "Confirmed higher low", "structure", "neutral", "higher_low_confirmed", "confirmed swings"),
    Factor("reversal_signal_count", "Reversal conditions", "structure", "neutral", "CAST(coalesce(prior_high_breakout, false) AS INT) + CAST(coalesce(trendline_breakout, false) AS INT) + CAST(coalesce(higher_low_confirmed, false) AS INT)", "the session"),
    Factor("early_reversal_score", "Early reversal", "structure", "neutral", "early_reversal_score", "the session and the one before", ranked=False),
    Factor("volume_ratio", "Volume ratio", "volume", "higher", "volume / nullif(mean_volume_20, 0)", "20 sessions"),
    Factor("atr20_pct", "ATR20", "risk", "lower", "atr20 / nullif(close, 0) * 100", "20 sessions"),
    Factor("realized_vol_63", "Realised volatility", "risk", "lower", "vol_63", "up to 63 sessions"),
    Factor("overheat_score", "Overheat", "risk", "lower", "overheat", "up to 200 sessions"),
    Factor("legacy_score", "Traditional rules", "legacy", "neutral", "legacy_score", "several", ranked=False),
)
