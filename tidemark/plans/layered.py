"""Queries that are stacks of layers, and the same stacks as SQL text for another engine to check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import layers as L
from tidemark.operators import state
from tidemark.sources import bars as B


def _shown(columns: str) -> list[str]:
    """`~x` is rounded to six places, `%x` to five, `^x` to eight, `#x` is a whole number, `@x` is a date as text, others stay."""
    out = []
    for c in columns.split():
        name = c.lstrip("~#@%^")
        kind = "@" if name in ("session", "label_end", "last_cross") else c[0]
        out.append({"%": f"round({name}, 5) AS {name}", "^": f"round({name}, 8) AS {name}", "~": f"round({name}, 6) AS {name}", "#": f"CAST({name} AS DOUBLE) AS {name}", "@": f"CAST({name} AS STRING) AS {name}"}.get(kind, name))
    return out


def base(spark: SparkSession, sf_dir: str, grain: str = "week", index: bool | str = False) -> DataFrame:
    """Bars, with the index beside them; index="group" adds the group's close and an exponential mean too."""
    rows = B.bars(spark, sf_dir, grain)
    if index:  # a row a session: small at any number of tickers, and its size is for Spark to see
        rows = rows.join(B.index_bars(spark, sf_dir, grain), "session", "left")
    if index == "group":
        rows = state.with_emas(rows.join(B.group_bars(spark, sf_dir, grain), ["ticker", "session"], "left"), (20,))
    return rows


def query(layers: list[L.Layer], columns: str, grain: str = "week", index: bool | str = False, where: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = L.stack(base(spark, sf_dir, grain, index), layers)
        return (out.where(where) if where else out).selectExpr(*_shown(columns))

    return run


def plain(text: str) -> str:
    """Double literals and the half-even rounding as other engines write them."""
    return re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"\1::DOUBLE", text).replace("bround(", "round_even(")


def stack_sql(layers: list[L.Layer], grain: str = "week", index: bool | str = False) -> str:
    """CTEs up to `top`."""
    first = f"SELECT b.*, i.* EXCLUDE (session) FROM ({B.bars_sql(grain)}) b LEFT JOIN ({B.index_bars_sql(grain)}) i USING (session)" if index else B.bars_sql(grain)
    if index == "group":
        first = f"SELECT b.*, g.g_close, e.ema20 FROM ({first}) b LEFT JOIN ({B.group_bars_sql(grain)}) g USING (ticker, session) LEFT JOIN ({B.emas_sql(grain, (20,))}) e USING (ticker, session)"
    parts = [f"s0 AS ({first})"]
    for k, layer in enumerate(layers):
        parts.append(f"s{k + 1} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in layer.items()) + f" FROM s{k})")
    return plain(", ".join(parts)) + f", top AS (SELECT * FROM s{len(layers)})"


def sql(layers: list[L.Layer], columns: str, grain: str = "week", index: bool | str = False, where: str | None = None) -> str:
    return f"WITH {stack_sql(layers, grain, index)} SELECT {', '.join(_shown(columns))} FROM top" + (f" WHERE {where}" if where else "")


P, C, T, S, R = L.PRESSURE, L.COUNTS, L.TREND, L.SIGNALS, L.RELATIVE
FULL = [*P, *C, *T, *S]



def _head(first: int, last: int, half: float) -> str:
    """Weighted mean of the log returns of so many sessions ago; null unless all are there."""
    weights = [(k, 0.5 ** ((k - first) / half)) for k in range(first, last + 1)]
    return "(" + " + ".join(f"{w!r}D * {L.lag('lr', k)}" for k, w in weights) + f") / {sum(w for _, w in weights)!r}D"


HEADS: list[L.Layer] = [{f"head_{a}_{b}": _head(a, b, h) for a, b, h in ((1, 3, 2), (4, 10, 4), (11, 20, 7), (21, 60, 20), (1, 20, 7))}]

SPECS: dict[str, tuple] = {
    "p04_daily_return": (P, "ticker session ~ret"),
    "p05_p06_close_location_wicks": (P, "ticker session ~cl ~uw ~lw"),
    "p07_p08_volume_ratios": (P, "ticker session ~vr ~vr_with"),
    "p09_p10_signed_volume_efficiency": (P, "ticker session ~sv ~eff"),
    "p11_distribution_day": (P, "ticker session distribution"),
    "p12_p13_non_progress_failed_breakout": (P, "ticker session non_progress failed_breakout"),
    "p14_capitulation_recovery": (P, "ticker session distress recovery"),
    "w01_moving_averages": (T[:1], "ticker session ~sma10 ~sma20 ~sma50 ~sma200"),
    "w06_high_low_252": ([*P, *T], "ticker session ~high_252 ~low_252 ~off_high ~off_low"),
    "w07_adr_dollar_volume": ([*P, *T], "ticker session %adr_20 %dollar_volume_20"),
    "w08_true_range_atr": ([*P, *T], "ticker session ~tr ~atr14 ~atr20"),
    "w09_skip_month_momentum": ([*P, *T], "ticker session ~mom_63 ~mom_126 ~mom_252"),
    "w10_realised_vol": ([*P, *T], "ticker session ~vol_63"),
    "w11_pocket_pivot": (FULL, "ticker session pocket_pivot #pocket_pivots_10"),
    "w12_pivot_breakout": (FULL, "ticker session pivot_breakout ~over_pivot"),
    "w14_up_streak": (FULL, "ticker session #up_streak"),
    "w15_w16_rolling_counts": ([*P, *C], "ticker session #distribution_5 #distribution_10 #distribution_20 #failed_10 #gated_up_10 #churn_10"),
    "w17_last_test_carry": ([*FULL, *L.CARRY], "ticker session tested accepted #sessions_since_test follow_window"),
    "w18_supply_demand": ([*FULL, *R, *L.CARRY, *L.SUPPLY], "ticker session #supply #demand pressure_state", "week", True),
    "w19_climax_run": ([*FULL, *L.CLIMAX], "ticker session #climax_score climax_candidate climax_conditions", "week", "group"),
    "w21_slow_decline": ([*FULL, *R, *L.DECLINE], "ticker session decline_score", "week", "group"),
    "w27_average_crosses": (FULL, "ticker session cross_up cross_down last_cross"),
    "w04_rs_rating": (L.STRENGTH, "ticker session ~strength ~strength_pct #rating", "week", False, "strength IS NOT NULL"),
    "w03_percentile_rank": ([*P, {"r": "round(ret, 2) + 0"}, {"pct": L.rank_pct("r", "session")}], "ticker session ~r ~pct"),
    "w41_relative_slope": ([*FULL, *R], "ticker session ~rs_slope", "week", True),
    "w42_relative_breakdown": ([*FULL, *R], "ticker session rs_breakdown ~ratio_mean_20", "week", True),
    "a21_rolling_beta": ([*FULL, *R], "ticker session ~beta_63", "week", True),
    "j02_exact_date_benchmark": ([*FULL, *R], "ticker session ~rel_5 ~rel_20", "week", True),
    "x07_tight_platform": ([*FULL, *L.PLATFORM], "ticker session ~width tight_platform"),
    "w28_forward_targets": (L.labels(5), "ticker session ^entry ^exit label_end ~fwd"),
    "w29_path_excursions": (L.labels(5), "ticker session ~mae ~mfe mature reason"),
    "w30_asymmetric_tails": (L.labels(5), "ticker session #tail_down #tail_up"),
    "p20_direction_bands": (L.labels(20), "ticker session direction"),
    "w23_decayed_momentum": ([*P, {"lr": "ln(close / nullif(pc, 0))"}, *HEADS], "ticker session ~head_1_3 ~head_4_10 ~head_11_20 ~head_21_60 ~head_1_20"),
    "w33_triple_barrier": (L.barrier(10, 0.08, 0.08), "ticker session #up_at #down_at barrier barrier_strict"),
}

QUERIES = {k: query(*v) for k, v in SPECS.items()}
ORACLE_SQL = {k: sql(*v) for k, v in SPECS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten tickers with the most distribution days in their last 20 sessions."""
    rows = L.stack(base(spark, sf_dir, "day"), [*P, *C])
    last = rows.groupBy("ticker").agg(F.max(F.struct("session", "distribution_20", "ret", "cl", "vr")).alias("x")).select("ticker", "x.*")
    return last.orderBy(F.desc_nulls_last("distribution_20"), "ticker").limit(10).selectExpr(*_shown("ticker session #distribution_20 ~ret ~cl ~vr"))


QUERIES["flagship_distribution_leaders"] = flagship
ORACLE_SQL["flagship_distribution_leaders"] = (
    f"WITH {stack_sql([*P, *C], 'day')} SELECT {', '.join(_shown('ticker session #distribution_20 ~ret ~cl ~vr'))} FROM top "
    "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY session DESC) = 1 ORDER BY distribution_20 DESC NULLS LAST, ticker LIMIT 10"
)
