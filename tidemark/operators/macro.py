"""Macro risk as of a date, from vintages that were known then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The rules of the macro score: component, rule, weight, value, threshold and its side.
RULES = (
    ("rates", "two_year_yield_high", 10.0, "DGS2", 4.5, ">="),
    ("rates", "two_year_yield_rising", 8.0, "DGS2_CHANGE", 0.5, ">="),
    ("rates", "yield_curve_inverted", 12.0, "CURVE_10Y_2Y", -0.5, "<="),
    ("inflation_energy", "cpi_yoy_elevated", 15.0, "CPI_YOY", 3.0, ">="),
    ("inflation_energy", "oil_price_shock", 10.0, "OIL_CHANGE", 15.0, ">="),
    ("credit_liquidity", "high_yield_spread_stressed", 15.0, "BAMLH0A0HYM2", 5.0, ">="),
    ("credit_liquidity", "high_yield_spread_widening", 10.0, "HY_CHANGE", 0.75, ">="),
    ("risk_aversion", "vix_elevated", 10.0, "VIXCLS", 25.0, ">="),
    ("risk_aversion", "vix_spiking", 5.0, "VIX_CHANGE", 5.0, ">="),
    ("risk_aversion", "dollar_surge", 5.0, "DOLLAR_CHANGE", 3.0, ">="),
)
#: value -> (series, calendar days back, whether in percent)
CHANGES = {
    "DGS2_CHANGE": ("DGS2", 20, False),
    "HY_CHANGE": ("BAMLH0A0HYM2", 20, False),
    "VIX_CHANGE": ("VIXCLS", 20, False),
    "OIL_CHANGE": ("DCOILWTICO", 20, True),
    "DOLLAR_CHANGE": ("DTWEXBGS", 20, True),
    "CPI_YOY": ("CPIAUCSL", 350, True),
}
SERIES = ("DGS2", "DGS10", "CPIAUCSL", "DCOILWTICO", "BAMLH0A0HYM2", "VIXCLS", "DTWEXBGS")
COVERAGE = 0.70


def values_at(vintages: DataFrame, dates: DataFrame) -> DataFrame:
    """asof and a column for each value of the rules, null where its series or history lacks.

    vintages: series_id, observation_date, available_at (timestamp), value, realtime_start. dates: asof (date); a date
    sees what was available by its end. Of an observation's visible vintages the newest counts. The series are a short
    list, so a date meets its own series' vintages by equality of a literal list and one inequality, and is one group after.
    """
    known = vintages.where(F.col("series_id").isin(*SERIES) & F.col("observation_date").isNotNull() & F.col("available_at").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    asked = dates.select("asof").distinct().select("asof", F.explode(F.array(*map(F.lit, SERIES))).alias("series_id"))
    seen = asked.join(known, "series_id").where(F.col("available_at") < F.date_add("asof", 1).cast("timestamp"))
    newest = seen.groupBy("asof", "series_id", "observation_date").agg(F.max_by("value", F.struct("available_at", "realtime_start")).alias("value"))
    last = newest.withColumn("latest", F.max("observation_date").over(Window.partitionBy("asof", "series_id")))
    picks = []
    for s in SERIES:
        mine = F.col("series_id") == s
        picks.append(F.max(F.when(mine & (F.col("observation_date") == F.col("latest")), F.col("value"))).alias(s))
    for name, (s, days, _) in CHANGES.items():
        old = (F.col("series_id") == s) & (F.col("observation_date") <= F.date_sub("latest", days))
        picks.append(F.max_by(F.when(old, F.col("value")), F.when(old, F.col("observation_date"))).alias(f"before_{name}"))
    wide = last.groupBy("asof").agg(*picks)
    changes = []
    for name, (s, _, percent) in CHANGES.items():
        now, before = F.col(s), F.col(f"before_{name}")
        changes.append((100 * (F.try_divide(now, before) - 1) if percent else now - before).alias(name))
    wide = wide.select("asof", *SERIES, (F.col("DGS10") - F.col("DGS2")).alias("CURVE_10Y_2Y"), *changes)
    return dates.select("asof").distinct().join(wide, "asof", "left")


def risk(values: DataFrame) -> DataFrame:
    """values with score (0 to 100), coverage, state, conditions, and each component's score and coverage.

    The score is the weight of the rules that are met over the weight of those whose value is known, and null where under
    COVERAGE of all weight is known.
    """
    known = lambda v: F.when(F.col(v).isNotNull(), 1.0).otherwise(0.0)
    met = {rule: F.coalesce(F.col(v) >= limit if side == ">=" else F.col(v) <= limit, F.lit(False)) for _, rule, _, v, limit, side in RULES}
    sums = {}
    for component in dict.fromkeys(r[0] for r in RULES):
        own = [r for r in RULES if r[0] == component]
        sums[component] = (sum((w * known(v) for _, _, w, v, _, _ in own), F.lit(0.0)), sum((F.when(met[rule], w).otherwise(0.0) for _, rule, w, _, _, _ in own), F.lit(0.0)), sum(r[2] for r in own))
    available, hit = (sum((s[i] for s in sums.values()), F.lit(0.0)) for i in (0, 1))
    score = F.when(available / 100 >= COVERAGE, F.round(100 * hit / available, 2))
    parts = [x for c, (a, h, w) in sums.items() for x in (F.round(F.try_divide(100 * h, a), 2).alias(f"{c}_score"), F.round(a / w, 4).alias(f"{c}_coverage"))]
    conditions = F.array_compact(F.array(*(F.when(m, rule) for rule, m in met.items())))
    out = values.select("*", score.alias("score"), F.round(available / 100, 4).alias("coverage"), conditions.alias("conditions"), *parts)
    state = F.when(F.col("score").isNull(), "unavailable").when(F.col("score") >= 70, "severe").when(F.col("score") >= 50, "high").when(F.col("score") >= 30, "watch").otherwise("low")
    return out.withColumn("state", state)
