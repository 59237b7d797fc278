"""Causal feature layers over bars.

A layer maps new columns to expressions over the columns below it; layers stack by projection, so Catalyst
merges windows of one partitioning into one sort of each ticker's history. All expressions read the current
and earlier sessions only; labels, which look ahead, are a layer of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.frames import BY, PAST, change, coverage_score, full, future, lag, lead, over, prior, rank_pct, rule, sma, sure, trailing

Layer = dict[str, str]


def stack(df: DataFrame, layers: list[Layer]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in layer.items()))
    return df


P20 = full("avg", "volume", 20, prior(20))

#: Daily returns, close location, wicks, volume ratios with and without the current session.
PRESSURE: list[Layer] = [
    {"pc": lag("close"), "mean_volume_before": P20, "mean_volume": sma("volume", 20), "top_close": full("max", "close", 20, prior(20))},
    {
        "ret": "close / nullif(pc, 0) - 1",
        "cl": "((close - low) - (high - close)) / nullif(high - low, 0)",
        "uw": "(high - greatest(open, close)) / nullif(high - low, 0)",
        "lw": "(least(open, close) - low) / nullif(high - low, 0)",
        "vr": "volume / nullif(mean_volume_before, 0)",
        "vr_with": "volume / nullif(mean_volume, 0)",
    },
    {
        "sv": "cl * vr",
        "eff": "abs(ret) / nullif(vr, 0)",
        "distribution": sure("ret < 0 AND vr >= 1.2 AND cl <= -0.4"),
        "non_progress": sure("vr >= 1.5 AND abs(ret) <= 0.005"),
        "failed_breakout": sure("high > top_close AND close <= top_close"),
        "distress": sure("ret < 0 AND vr >= 1.5 AND cl <= -0.5"),
    },
    {"recovery": sure(f"{lag('distress')} AND ret > 0 AND cl >= 0.4")},
]

#: Rolling counts; those with a gate need all inputs.
COUNTS: list[Layer] = [
    {
        **{f"distribution_{n}": full("sum", "CASE WHEN distribution THEN 1 ELSE 0 END", n, trailing(n)) for n in (5, 10, 20)},
        "failed_10": full("sum", "CASE WHEN failed_breakout THEN 1 ELSE 0 END", 10, trailing(10)),
        "gated_up_10": f"CASE WHEN count(ret) {trailing(10)} = 10 THEN sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) {trailing(10)} END",
        "churn": "CASE WHEN vr IS NOT NULL AND cl IS NOT NULL AND ret IS NOT NULL THEN non_progress OR (vr >= 1.5 AND abs(ret) <= 0.01 AND cl <= -0.2) END",
    },
    {"churn_10": full("sum", "CASE WHEN churn THEN 1 WHEN NOT churn THEN 0 END", 10, trailing(10))},
]

TREND: list[Layer] = [
    {
        **{f"sma{n}": sma("close", n) for n in (10, 20, 50, 200)},
        "high_252": full("max", "high", 252, trailing(252)),
        "low_252": full("min", "low", 252, trailing(252)),
        "adr_20": full("avg", "((high / nullif(low, 0) - 1) * 100)", 20, trailing(20)),
        "dollar_volume_20": full("avg", "(close * volume)", 20, trailing(20)),
        "tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))",
        **{f"mom_{n}": f"{lag('close', 21)} / nullif({lag('close', n)}, 0) - 1" for n in (63, 126, 252)},
        **{f"chg_{n}": change("close", n) for n in (5, 10, 15, 20, 60)},
    },
    {
        "atr14": sma("tr", 14),
        "atr20": sma("tr", 20),
        "off_high": "close / nullif(high_252, 0) - 1",
        "off_low": "close / nullif(low_252, 0) - 1",
        "vol_63": full("stddev_samp", "ret", 63, trailing(63), 40) + " * sqrt(252D)",
        "ext_ma20": "(close / nullif(sma20, 0) - 1) * 100",
    },
]

#: Up-volume against the strongest down volume, breakouts over a pivot, runs of up sessions.
SIGNALS: list[Layer] = [
    {
        "down_volume": "CASE WHEN ret < 0 THEN volume END",
        "pos": f"CAST(row_number() OVER ({BY}) AS BIGINT)",
        "pivot_close": full("max", "close", 20, prior(20)),
        "mean_volume_50": sma("volume", 50),
    },
    {
        "pocket_pivot": sure(f"ret > 0 AND volume > max(down_volume) {prior(10)}"),
        "pivot_breakout": sure("close > pivot_close AND volume / nullif(mean_volume_50, 0) >= 1.4"),
        "over_pivot": "(close / nullif(pivot_close, 0) - 1) * 100",
        "last_not_up": f"max(CASE WHEN ret > 0 THEN NULL ELSE pos END) {over('UNBOUNDED PRECEDING', 'CURRENT ROW')}",
        "cross_up": sure(f"close >= sma20 AND {lag('close')} < {lag('sma20')}"),
        "cross_down": sure(f"close < sma20 AND {lag('close')} >= {lag('sma20')}"),
    },
    {
        "up_streak": "pos - last_not_up",
        "pocket_pivots_10": f"sum(CASE WHEN pocket_pivot THEN 1 ELSE 0 END) {trailing(10)}",
        "last_cross": f"max(CASE WHEN cross_up OR cross_down THEN session END) {over('UNBOUNDED PRECEDING', 'CURRENT ROW')}",
    },
]

#: Against the index of the same session; a missing index session leaves nulls.
RELATIVE: list[Layer] = [
    {"m_chg_5": change("m_close", 5), "m_chg_20": change("m_close", 20), "ratio": "close / nullif(m_close, 0)", "log_ratio": "ln(close / nullif(m_close, 0))"},
    {
        "rel_5": "chg_5 - m_chg_5",
        "rel_20": "chg_20 - m_chg_20",
        "ratio_mean_20": sma("ratio", 20),
        "rs_slope": f"CASE WHEN count(log_ratio) {trailing(20)} = 20 THEN regr_slope(log_ratio, pos) {trailing(20)} END",
        "beta_63": f"CASE WHEN count(chg_5) {trailing(63)} = 63 THEN covar_pop(chg_5, m_chg_5) {trailing(63)} / nullif(var_pop(m_chg_5) {trailing(63)}, 0) END",
    },
    {"rs_breakdown": sure(f"ratio < ratio_mean_20 AND {lag('ratio')} >= {lag('ratio_mean_20')}")},
]

#: Relative strength: the composite of four horizons, ranked over the session and mapped to 1..99.
STRENGTH: list[Layer] = [
    {"strength": f"0.4D * ({change('close', 63)}) + 0.2D * ({change('close', 126)}) + 0.2D * ({change('close', 189)}) + 0.2D * ({change('close', 252)})"},
    {"strength_pct": rank_pct("strength", "session")},
    {"rating": "least(99, greatest(1, bround(1 + 98 * strength_pct, 0)))"},
]

#: Tests of the breakout pivot carried to later sessions, and what came of breakouts.
CARRY: list[Layer] = [
    {
        "tested": sure("ret > 0 AND abs(high / nullif(pivot_close, 0) - 1) <= 0.02"),
        "accepted": sure("close / nullif(pivot_close, 0) - 1 > 0 AND close / nullif(pivot_close, 0) - 1 <= 0.05 AND vr >= 1.2"),
    },
    {
        "last_test_pos": f"max(CASE WHEN tested THEN pos END) {PAST}",
        "last_accept_pos": f"max(CASE WHEN accepted THEN pos END) {PAST}",
    },
    {"sessions_since_test": "pos - last_test_pos", "follow_window": sure("pos - last_accept_pos BETWEEN 1 AND 3")},
]

#: Slow decline: nine weighted rules, scored where four fifths of the weight is available. Reads ema20 and the group's g_close.
_DECLINE = [
    rule("chg_20", 15, "<= -0.05", "<= 0"),
    rule("chg_60", 15, "<= -0.10", "<= -0.03"),
    rule("(close - ema20)", 15, "< 0"),
    rule("ema20_slope", 10, "<= -0.005", "<= 0"),
    rule("(close - sma50)", 15, "< 0"),
    rule("chg_5", 10, "<= -0.02", "<= 0"),
    rule("distribution_20", 10, ">= 3", ">= 1"),
    rule("group_rel_20", 5, "<= -0.03", "<= 0"),
    rule("rel_20", 5, "<= -0.03", "<= 0"),
]
DECLINE: list[Layer] = [
    {"ema20_slope": change("ema20", 5), "g_chg_20": change("g_close", 20)},
    {"group_rel_20": "chg_20 - g_chg_20"},
    {"decline_score": f"round({coverage_score(_DECLINE, 0.8, 100)}, 2)"},
]

#: Climax run: six conditions of 20 points each, at most 100; a candidate if three hold after an advance of 30 percent in 60 sessions.
_CLIMAX = {
    "acceleration": "chg_15 >= 0.25",
    "repeated_large_up_days": f"{full('sum', '(CASE WHEN ret >= 0.018 THEN 1 ELSE 0 END)', 10, trailing(10))} >= 3",
    "range_expansion": "atr5 / nullif(atr20, 0) >= 1.35",
    "ema_extension": "(close - ema20) / nullif(atr20, 0) >= 2.5",
    "abnormal_volume": f"{full('sum', '(CASE WHEN vr >= 1.8 THEN 1 ELSE 0 END)', 10, trailing(10))} >= 2",
    "repeated_gap_up": f"{full('sum', '(CASE WHEN gap_up THEN 1 ELSE 0 END)', 10, trailing(10))} >= 2",
}
CLIMAX: list[Layer] = [
    {"gap_up": sure(f"open / nullif({lag('high')}, 0) - 1 >= 0.015"), "atr5": sma("tr", 5)},
    {f"c_{k}": sure(v) for k, v in _CLIMAX.items()},
    {"n_climax": " + ".join(f"CASE WHEN c_{k} THEN 1 ELSE 0 END" for k in _CLIMAX), "climax_conditions": "concat_ws(',', " + ", ".join(f"CASE WHEN c_{k} THEN '{k}' END" for k in _CLIMAX) + ")"},
    {"climax_score": "least(100, 20 * n_climax)", "climax_candidate": sure("chg_60 >= 0.30 AND n_climax >= 3")},
]

#: Supply pressure from capped groups of atoms.
SUPPLY: list[Layer] = [
    {
        "s_close": "least(40, CASE WHEN distribution THEN 25 ELSE 0 END + CASE WHEN non_progress THEN 15 ELSE 0 END + CASE WHEN sv <= -0.75 THEN 15 ELSE 0 END + CASE WHEN distribution_10 >= 2 THEN 15 ELSE 0 END)",
        "s_reject": "least(30, CASE WHEN uw >= 0.35 AND vr >= 1.2 THEN 15 ELSE 0 END + CASE WHEN failed_breakout THEN 20 ELSE 0 END + CASE WHEN failed_10 >= 2 THEN 10 ELSE 0 END)",
        "s_structure": f"least(30, CASE WHEN close < sma20 AND {lag('close')} >= {lag('sma20')} AND vr >= 1.2 THEN 15 ELSE 0 END + CASE WHEN rel_20 <= -0.03 THEN 10 ELSE 0 END)",
        "d_part": "least(35, CASE WHEN sv >= 0.75 THEN 15 ELSE 0 END + CASE WHEN ret > 0 AND vr >= 1.2 AND cl >= 0.4 THEN 20 ELSE 0 END + CASE WHEN cl >= 0.6 THEN 10 ELSE 0 END)",
        "d_absorb": f"least(35, CASE WHEN vr >= 1.8 AND low >= 0.995 * min(low) {prior(5)} AND cl >= 0 THEN 15 ELSE 0 END + CASE WHEN low < min(low) {prior(5)} AND min(low) {prior(5)} < close AND cl >= 0.4 AND vr >= 1.2 THEN 20 ELSE 0 END)",
        "d_break": "least(30, CASE WHEN accepted THEN 15 ELSE 0 END + CASE WHEN follow_window AND NOT distribution THEN 10 ELSE 0 END + CASE WHEN rel_20 >= 0.02 THEN 10 ELSE 0 END)",
        "known": "vr IS NOT NULL AND cl IS NOT NULL AND rel_20 IS NOT NULL",
    },
    {"supply": "CASE WHEN known THEN s_close + s_reject + s_structure END", "demand": "CASE WHEN known THEN d_part + d_absorb + d_break END"},
    {
        "pressure_state": "CASE WHEN supply IS NULL OR demand IS NULL THEN 'unavailable' WHEN supply >= 50 AND demand >= 50 THEN 'two_way_contest' WHEN supply >= 60 AND demand < 50 THEN 'distribution_risk' "
        "WHEN demand >= 60 AND supply < 40 THEN 'healthy_advance' WHEN supply < 40 AND demand < 40 THEN 'low_participation' ELSE 'mixed' END"
    },
]

#: Tight platform: narrow and quiet over 20 sessions.
PLATFORM: list[Layer] = [
    {
        "width": f"(max(high) {trailing(20)} / nullif(min(low) {trailing(20)}, 0) - 1) * 100",
        "path": full("sum", "abs(ret)", 20, trailing(20)),
    },
    {"tight_platform": sure("pos >= 20 AND width <= greatest(6, 4 * atr20 / nullif(close, 0) * 100) AND abs(chg_20) / nullif(path, 0) <= 0.35")},
]

#: A bar whose four prices are numbers: what is infinite, NaN or missing minus itself is not 0.
FINITE = " AND ".join(f"{c} - {c} = 0" for c in ("open", "high", "low", "close"))


#: Labels: entry at the next open, exit h sessions on, the path between, and why one is missing. An outcome is mature when
#: all h bars of the path are finite and the entry is above 0, else all outcomes are null.
def labels(h: int) -> list[Layer]:
    return [
        {
            "entry": lead("open"),
            "exit": lead("close", h),
            "label_end": lead("session", h),
            "path_low": full("min", "low", h, future(h)),
            "path_high": full("max", "high", h, future(h)),
            "path_close_low": full("min", "close", h, future(h)),
            "path_bars": f"count(CASE WHEN {FINITE} THEN 1 END) {future(h)}",
        },
        {"mature": sure(f"path_bars = {h} AND entry > 0")},
        {
            "fwd": "CASE WHEN mature THEN exit / entry - 1 END",
            "mae": "CASE WHEN mature THEN path_low / entry - 1 END",
            "mfe": "CASE WHEN mature THEN path_high / entry - 1 END",
            "reason": "CASE WHEN mature THEN NULL WHEN label_end IS NULL THEN 'immature_future_path' ELSE 'invalid_future_path' END",
        },
        {
            "tail_down": "CASE WHEN mature THEN fwd <= -0.05 OR mae <= -0.07 END",
            "tail_up": "CASE WHEN mature THEN mfe >= 0.10 END",
            "direction": "CASE WHEN fwd IS NULL THEN NULL WHEN fwd > 0.02 THEN 'up' WHEN fwd < -0.02 THEN 'down' ELSE 'neutral' END",
        },
    ]


def barrier(h: int, up: float, down: float) -> list[Layer]:
    """First touch of a barrier over the entry within h sessions; both on one session counts as down, or is ambiguous."""
    hit = lambda side: "least(" + ", ".join(f"CASE WHEN {lead('high' if side > 0 else 'low', k)} {'>=' if side > 0 else '<='} entry_b * {1 + up if side > 0 else 1 - down}D THEN {k} ELSE {h + 1} END" for k in range(1, h + 1)) + ")"
    return [
        {"entry_b": lead("open"), "last_b": lead("close", h)},
        {"up_at": hit(1), "down_at": hit(-1)},
        {
            "barrier": f"CASE WHEN last_b IS NULL THEN NULL WHEN up_at > {h} AND down_at > {h} THEN 'timeout' WHEN down_at <= up_at THEN 'down' ELSE 'up' END",
            "barrier_strict": f"CASE WHEN last_b IS NULL THEN NULL WHEN up_at > {h} AND down_at > {h} THEN 'timeout' WHEN down_at = up_at THEN 'ambiguous' WHEN down_at < up_at THEN 'down' ELSE 'up' END",
        },
    ]
