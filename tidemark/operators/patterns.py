"""Base patterns and support reactions along a ticker's history, as grouped maps over bounded windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.state import swings

BASES = range(20, 81)


class Swings:
    """Confirmed highs and lows of closes under one threshold, from any start, as pivots() finds them.

    Once a swing is confirmed, what follows depends only on where that was and on its kind; so walks from different starts become
    one, and each stretch is walked once.
    """

    def __init__(self, close: np.ndarray, threshold: float):
        self.close, self.up, self.down, self.known = close.tolist(), 1 + threshold, 1 - threshold, {}

    def _next(self, at: int, kind: str, either: bool = False) -> tuple[int, int, str] | None:
        """The next swing after one that was confirmed at `at`, which was of that kind; from a start either kind may come."""
        c, top, bottom = self.close, at, at
        for i in range(at + 1, len(c)):
            x = c[i]
            if x > c[top]:
                top = i
            if x < c[bottom]:
                bottom = i
            if (either or kind == "low") and top < i and x <= c[top] * self.down:
                return top, i, "high"
            if (either or kind == "high") and bottom < i and x >= c[bottom] * self.up:
                return bottom, i, "low"
        return None

    def since(self, start: int) -> list[tuple[int, str]]:
        """(place, kind) of all swings of the closes from start on."""
        out, swing = [], self._next(start, "", True)
        while swing is not None:
            place, at, kind = swing
            out.append((place, kind))
            if (at, kind) not in self.known:
                self.known[at, kind] = self._next(at, kind)
            swing = self.known[at, kind]
        return out


def legs(high: np.ndarray, low: np.ndarray, marks: list[tuple[int, str]]) -> list[tuple[int, int, float]]:
    """(peak, trough, depth in percent) of the falls between swings, the last four of at least two percent."""
    out = []
    for (a, first), (b, second) in zip(marks, marks[1:]):
        if first == "high" and second == "low":
            depth = (high[a] - low[b]) / high[a] * 100
            if depth >= 2:
                out.append((a, b, depth))
    return out[-4:]


def contraction(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, threshold: float) -> dict:
    """The best volatility contraction that ends at the last session, or why there is none.

    Of bases of 20 to 80 sessions at most 35 percent deep, those count whose falls shrink by a twentieth each
    and by a quarter in all. The best has the most falls, then the smallest last to first fall, the
    tightest last ten sessions, the newest trough and the shortest length.
    """
    n, price = len(close), close[-1]
    if n < 60:
        return {"stage": "insufficient_history"}
    mean50 = close[-50:].mean()
    if price <= mean50:
        return {"stage": "below_ma50"}
    if n >= 200 and mean50 < close[-200:].mean():
        return {"stage": "long_trend_not_rising"}
    # Ranges, ends and paths of all bases at once, from the last session back; only those that pass are walked.
    size = min(n, BASES[-1])
    h, lo, c = high[-size:], low[-size:], close[-size:]
    lengths = np.arange(BASES[0], size + 1)
    tops, bottoms = np.maximum.accumulate(h[::-1])[lengths - 1], np.minimum.accumulate(lo[::-1])[lengths - 1]
    travel = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(c))[::-1])])[lengths - 1]
    starts = c[size - lengths]
    shallow = (tops - bottoms) / tops <= 0.35
    sideways = ~((c[-1] / starts - 1 > 0.15) & (np.abs(c[-1] - starts) > 0.5 * travel))
    tight = (h[-10:].max() - lo[-10:].min()) / price * 100
    walk, best, swung = Swings(c, threshold), None, False
    for length in lengths[shallow & sideways].tolist():
        found = legs(h, lo, walk.since(size - length))
        if len(found) < 2:
            continue
        swung = True
        depths = [d for _, _, d in found]
        if any(b > 0.95 * a for a, b in zip(depths, depths[1:])) or depths[-1] > 0.75 * depths[0] or depths[0] - depths[-1] < 3:
            continue
        score = (len(found), -depths[-1] / depths[0], -tight, found[-1][1] - size, -length)
        if best is None or score > best[0]:
            best = (score, length, depths, float(h[found[-1][0]]))
    if best is None:
        return {"stage": "contractions_not_decreasing" if swung else "insufficient_swings"}
    _, length, depths, pivot = best
    distance = (price / pivot - 1) * 100
    stage = "extended" if distance > 5 else "breakout" if distance > 0 else "near_pivot" if distance >= -5 else "forming"
    return {"stage": stage, "base": length, "n_legs": len(depths), "first_depth": depths[0], "last_depth": depths[-1], "pivot": pivot, "distance": distance, "dry_up": float(volume[-10:].mean() / volume[-50:].mean())}


def contractions(df: DataFrame, every: int = 1) -> DataFrame:
    """contraction() at every so many sessions of each ticker, from the 200 sessions up to it."""
    names = ("stage", "base", "n_legs", "first_depth", "last_depth", "pivot", "distance", "dry_up")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session").reset_index(drop=True)
        h, lo, c, v, t = (pdf[k].to_numpy(float) for k in ("high", "low", "close", "volume", "range_share"))
        rows = []
        for i in range(len(pdf)):
            if (i + 1) % every:
                continue
            s = slice(max(0, i - 199), i + 1)
            threshold = float(np.clip(1.5 * t[i], 0.03, 0.10)) if np.isfinite(t[i]) else 0.03
            got = contraction(h[s], lo[s], c[s], v[s], threshold)
            rows.append((pdf["ticker"][i], pdf["session"][i], *(got.get(k) for k in names)))
        return pd.DataFrame(rows, columns=["ticker", "session", *names]).astype({k: float for k in names[1:]})

    inner = df.select("ticker", "session", "high", "low", "close", "volume", (F.col("atr20") / F.col("close")).alias("range_share"))
    return inner.groupBy("ticker").applyInPandas(run, "ticker string, session date, stage string, " + ", ".join(f"{k} double" for k in names[1:]))


def reaction(bars: dict[str, np.ndarray], at: int, kind: str, lower: float, upper: float, span: float, sessions: int) -> tuple:
    """(label, sessions to a close over the zone, rebound and penetration in mean ranges, change of close, volume ratio) from the touch on.

    Failed: two closes in a row under the zone, one half a range under it, or a gap through it that no close takes back.
    Accepted: else, with a close at or over the zone's top. Ambiguous: neither.
    """
    high, low, close, volume = (bars[c][at : at + sessions] for c in ("high", "low", "close", "volume"))
    under = close < lower
    failed = (under[1:] & under[:-1]).any() or (close < lower - 0.5 * span).any() or (kind == "gap_through" and under.all())
    over = np.flatnonzero(close >= upper)
    label = "failed" if failed else "accepted" if len(over) else "ambiguous"
    mean = bars["mean_volume"][at]
    return (label, int(over[0]) if len(over) else None, max(0.0, (high.max() - upper) / span), max(0.0, (lower - low.min()) / span), close[-1] / close[0] - 1, volume[0] / mean if mean > 0 else None)


TOUCH = "ticker string, session date, lower double, upper double, distance double, touched date, delay long, kind string, outcome string, reclaim long, rebound double, penetration double, change double, volume_ratio double"


def support_touches(df: DataFrame, waiting: int = 20, sessions: int = 3, far: float = 3.5, apart: int = 10, moved: float = 0.25) -> DataFrame:
    """First touches of support zones, and how the price reacted in `sessions` sessions; zones not touched in time have no touch.

    df: ticker, session, high, low, close, volume, atr20, mean_volume (of the 20 sessions before), lower and upper of the
    zone known at the session's close (null for none). An observation needs a close over the zone by at most `far` mean
    ranges and a whole future. Episodes of a ticker don't overlap, and one begins only `apart` sessions after the one before
    began, unless the zone's centre has moved by `moved` of its range. So observations go in order along a ticker.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session").reset_index(drop=True)
        bars = {c: pdf[c].to_numpy(float) for c in ("high", "low", "close", "volume", "atr20", "mean_volume", "lower", "upper")}
        day, rows, before, busy = list(pdf["session"]), [], None, -1
        lower, upper, span = bars["lower"], bars["upper"], bars["atr20"]
        with np.errstate(invalid="ignore", divide="ignore"):
            distance = (bars["close"] - upper) / span
            able = (lower > 0) & (lower <= upper) & (span > 0) & (distance > 0) & (distance <= far)
        for i in np.flatnonzero(able[: max(0, len(pdf) - waiting - sessions + 1)]):
            centre = (lower[i] + upper[i]) / 2
            if i <= busy or (before and i - before[0] < apart and abs(centre - before[1]) < moved * before[2]):
                continue
            ahead = slice(i + 1, i + waiting + 1)
            met = np.flatnonzero(bars["low"][ahead] <= upper[i])  # below the zone altogether is a gap through it
            common = (pdf["ticker"][0], day[i], lower[i], upper[i], distance[i])
            if len(met):
                at = i + 1 + int(met[0])
                kind = "gap_through" if bars["high"][at] < lower[i] else "intersection"
                rows.append((*common, day[at], at - i, kind, *reaction(bars, at, kind, lower[i], upper[i], span[i], sessions)))
                busy = at + sessions - 1
            else:
                rows.append((*common, None, None, None, "not_touched", None, None, None, None, None))
                busy = i + waiting
            before = (i, centre, span[i])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TOUCH.split(", ")]).astype({"delay": "Int64", "reclaim": "Int64"})

    columns = ("ticker", "session", "high", "low", "close", "volume", "atr20", "mean_volume", "lower", "upper")
    return df.select(*columns).groupBy("ticker").applyInPandas(run, TOUCH)


#: States of a bottom in order of their rank, from 1.
RANKS = ("potential_support", "seller_exhaustion_watch", "early_bullish_reversal_watch", "bullish_structure_confirmed", "breakout_retest_confirmed")

#: The evidence that bottom_states() reads beside the bars.
EVIDENCE = ("support_lower", "support_upper", "support_score", "support_state", "demand_score", "demand_coverage", "demand_conditions", "early_watch", "higher_low", "prior_high_breakout", "trendline_breakout", "market_state")


def bottom_scores(df: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """df with the five components' scores, coverage, score and what the state machine reads; all of it in Spark's windows.

    df: ticker, session, low, close, volume, ema20 and EVIDENCE (demand_conditions an array of names, flags null for false).
    A disabled component has no points and is not available.
    """
    by = "OVER (PARTITION BY ticker ORDER BY session"
    full = lambda agg, x, n, first, last: f"CASE WHEN count({x}) {by} ROWS BETWEEN {first} AND {last}) = {n} THEN {agg}({x}) {by} ROWS BETWEEN {first} AND {last}) END"
    df = df.selectExpr(
        "*",
        f"{full('max', 'close', 63, '62 PRECEDING', 'CURRENT ROW')} AS peak63",
        f"{full('avg', 'volume', 20, '19 PRECEDING', 'CURRENT ROW')} AS volume20",
        f"{full('min', 'low', 10, '10 PRECEDING', '1 PRECEDING')} AS prior_low10",
        f"close / nullif(lag(close, 20) {by}), 0) - 1 AS back20",
        f"ema20 / nullif(lag(ema20, 5) {by}), 0) - 1 AS slope5",
        f"row_number() {by}) AS place",
    )
    votes = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in ("close < ema20", "slope5 < 0", "back20 <= -0.08", "close / peak63 - 1 <= -0.15"))
    df = df.selectExpr("*", f"coalesce(({votes}) >= 2 AND peak63 IS NOT NULL, false) AS downtrend")
    has = lambda name: f"coalesce(array_contains(demand_conditions, '{name}'), false)"
    flag = lambda name, points: f"CASE WHEN coalesce({name}, false) THEN {points} ELSE 0 END"
    near = "(support_state IN ('inside', 'testing') OR greatest(0, (close / support_upper - 1) * 100) <= 3)"
    parts = {
        "location": ("support_score IS NOT NULL AND support_upper IS NOT NULL AND close > 0", f"CASE WHEN {near} THEN least(20, 10 + support_score * 0.1) ELSE least(6, support_score * 0.06) END"),
        "exhaustion": ("demand_coverage > 0", " + ".join(f"CASE WHEN {has(n)} THEN {p} ELSE 0 END" for n, p in (("seller_exhaustion", 10), ("buyer_absorption", 8), ("low_volume_higher_low", 7)))),
        "demand": ("demand_score IS NOT NULL AND demand_coverage > 0", "least(25, demand_score * 0.25)"),
        "structure": ("true", "least(20, " + " + ".join(flag(n, p) for n, p in (("early_watch", 5), ("higher_low", 7), ("prior_high_breakout", 8), ("trendline_breakout", 8))) + ")"),
        "environment": ("market_state <> 'unavailable' AND market_state <> ''", "CASE market_state WHEN 'confirmed_uptrend' THEN 10 WHEN 'rally_attempt' THEN 5 WHEN 'uptrend_under_pressure' THEN 5 ELSE 0 END"),
    }
    known = {n: "false" if n in disabled else f"coalesce({k}, false)" for n, (k, _) in parts.items()}
    # Points for exhaustion count by the conditions alone; its coverage says whether they were looked for.
    points = {n: "0" if n in disabled else x if n in ("exhaustion", "structure") else f"CASE WHEN {known[n]} THEN {x} ELSE 0 END" for n, (_, x) in parts.items()}
    covered = " + ".join(f"CASE WHEN {known[n]} THEN 1 ELSE 0 END" for n in ("location", "exhaustion", "demand"))
    df = df.selectExpr("*", *(f"CAST({x} AS DOUBLE) AS {n}" for n, x in points.items()), f"(1 + {covered} + CASE WHEN {known['structure']} OR {known['environment']} THEN 1 ELSE 0 END) / 5.0D AS coverage")
    return df.selectExpr(
        "*",
        f"max(CASE WHEN downtrend THEN 1 ELSE 0 END) {by} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 1 AS recent_downtrend",
        "least(100, location + exhaustion + demand + structure + environment) AS score",
        "coalesce(low < prior_low10 AND volume / nullif(volume20, 0) >= 1.2, false) AS loud_low",
        "coalesce(support_lower, prior_low10) AS invalidation",
        f"{has('breakout_follow_through')} AS follow_through",
        "coalesce(prior_high_breakout, false) OR coalesce(trendline_breakout, false) AS any_breakout",
    )


def bottom_walk(rows: list, memory: int = 10, failure: int = 3, history: int = 63) -> list[tuple]:
    """(state, raw state, age, invalidation level) of each of one ticker's rows in order.

    A state holds its rank for `memory` sessions unless one at least as high renews it, which also freezes the level that
    would prove it wrong. From seller exhaustion on, a loud new low or a close a hundredth under the frozen level is a
    failure, which is shown for `failure` sessions more. Without history, context or coverage a row by itself is unavailable.
    """
    held, age, level, out = "unavailable", None, None, []
    rank = lambda s: RANKS.index(s) + 1 if s in RANKS else 0

    def by_itself(r, recent: bool) -> str:
        if r.place < history or not (r.downtrend or r.recent_downtrend or recent) or r.coverage < 0.6:
            return "unavailable"
        tests = (
            (recent and r.follow_through and (r.higher_low or r.location >= 10), 5),
            (r.higher_low and r.any_breakout, 4),
            (r.early_watch and r.demand >= 12.5, 3),
            (r.location >= 10 and r.exhaustion >= 8, 2),
            (r.location >= 10, 1),
        )
        return next((RANKS[k - 1] for met, k in tests if met), "downtrend_continuation")

    for r in rows:
        recent = rank(held) > 0 and age < memory
        raw = by_itself(r, recent)
        fresh = None if raw == "unavailable" else 0
        broken = level is not None and r.close < 0.99 * level
        if recent and rank(held) >= 2 and (r.loud_low or broken):
            held, age = "bottom_failed", 0
        elif held == "bottom_failed" and age < failure:
            age += 1
        elif held == "bottom_failed":
            held, age, level = raw, fresh, None
        elif rank(raw) and rank(raw) >= rank(held):
            held, age, level = raw, 0, level if r.invalidation is None or np.isnan(r.invalidation) else r.invalidation
        elif rank(held) and age < memory:
            age += 1
        else:
            held, age, level = raw, fresh, level if rank(raw) else None
        out.append((held, raw, age, level if rank(held) else None))
    return out


def bottom_states(df: DataFrame, disabled: tuple[str, ...] = (), memory: int = 10, failure: int = 3) -> DataFrame:
    """ticker, session, state, raw_state, age, invalidation, score, coverage and the components of bottom_scores().

    Scores come from windows; a grouped map walks a ticker's sessions, which the calendar bounds.
    """
    shown = ("score", "coverage", "location", "exhaustion", "demand", "structure", "environment")
    schema = "ticker string, session date, state string, raw_state string, age long, invalidation double, " + ", ".join(f"{c} double" for c in shown)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session").reset_index(drop=True)
        found = bottom_walk(list(pdf.itertuples()), memory, failure)
        out = pdf[["ticker", "session"]].assign(state=[x[0] for x in found], raw_state=[x[1] for x in found], age=pd.array([x[2] for x in found], "Int64"), invalidation=[x[3] for x in found])
        return pd.concat([out, pdf[list(shown)]], axis=1)

    read = ["ticker", "session", "close", "place", "downtrend", "recent_downtrend", "loud_low", "invalidation", "follow_through", "any_breakout", *shown]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("early_watch", "higher_low")]
    return bottom_scores(df, disabled).select(*read, *flags).groupBy("ticker").applyInPandas(run, schema)


def trendlines(df: DataFrame) -> DataFrame:
    """The line through the last two confirmed falling highs of closes, breakouts over it, and sessions that confirm a higher low.

    A swing counts from the session that confirms it. A breakout needs the same two highs on the session before. A low is higher
    by a quarter of the mean range at least.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session").reset_index(drop=True)
        close, span = pdf["close"].to_numpy(float), pdf["atr20"].to_numpy(float)
        marks = swings(close, np.clip(1.5 * span / close, 0.03, 0.10))
        by_day: dict[int, list[tuple[int, str]]] = {}
        for place, confirmed, kind in marks:
            by_day.setdefault(confirmed, []).append((place, kind))
        tops, lows, before, rows = [], [], None, []
        for i in range(len(pdf)):
            rising = False
            for place, kind in by_day.get(i, ()):
                (tops if kind == "high" else lows).append(place)
                rising = kind == "low" and len(lows) > 1 and bool(close[lows[-1]] - close[lows[-2]] >= 0.25 * span[i])
            line, pair = None, None
            if len(tops) > 1 and close[tops[-1]] < close[tops[-2]]:
                a, b = pair = tuple(tops[-2:])
                line = close[b] + (close[b] - close[a]) / (b - a) * (i - b)
            crossed = before is not None and line is not None and before[0] == pair and close[i - 1] <= before[1] and close[i] > line
            before = (pair, line) if line is not None else None
            rows.append((pdf["ticker"][i], pdf["session"][i], line, crossed, rising))
        return pd.DataFrame(rows, columns=["ticker", "session", "line", "breakout", "higher_low"])

    return df.select("ticker", "session", "close", "atr20").groupBy("ticker").applyInPandas(run, "ticker string, session date, line double, breakout boolean, higher_low boolean")
