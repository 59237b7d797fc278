"""Operators that carry state along a ticker's sessions.

Each is a grouped map over one ticker's history, which a calendar bounds; Spark shuffles by ticker once. The
per-ticker steps are small functions of arrays, so that a stream can call them too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emas(df: DataFrame, spans: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """ticker, session and an exponential mean of close for each span, seeded with the first close."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        out = pdf[["ticker", "session"]].copy()
        for n in spans:
            out[f"ema{n}"] = pdf["close"].ewm(span=n, adjust=False).mean()
        return out

    return df.select("ticker", "session", "close").groupBy("ticker").applyInPandas(run, "ticker string, session date, " + ", ".join(f"ema{n} double" for n in spans))


def with_emas(df: DataFrame, spans: tuple[int, ...] = (20,)) -> DataFrame:
    """df's columns and an exponential mean of close for each span, seeded with the first close."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *(f"ema{n} double" for n in spans)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        return pdf.assign(**{f"ema{n}": pdf["close"].ewm(span=n, adjust=False).mean() for n in spans})

    return df.groupBy("ticker").applyInPandas(run, schema)


def remember(raw: np.ndarray, half_life: float = 5.0, window: int = 10, active: float = 20.0) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Risk memory: (score, age in known sessions, label) of each session.

    The memory at a known session is the highest of its own score and of earlier ones, each halved for every half_life of
    known sessions since; scores of `window` or more sessions ago are forgotten, once one is replaced it does not return.
    So it is a fold over (value, age). Missing scores are unavailable and take no part.
    """
    known = np.flatnonzero(np.isfinite(raw))
    scores, ages, labels = np.full(len(raw), np.nan), np.full(len(raw), np.nan), ["unavailable"] * len(raw)
    value, age = -np.inf, window
    for i in known:
        faded = value * 2.0 ** (-1 / half_life) if age + 1 < window else -np.inf
        kind = "persistent" if value >= active else "new"
        value, age = max((raw[i], -0), (faded, -(age + 1)))
        age = -age
        scores[i], ages[i] = value, age
        labels[i] = "inactive" if value < active else kind if age == 0 else "fading"
    return scores, ages, labels


def memory(df: DataFrame, value: str, reset: str | None = None) -> DataFrame:
    """ticker, session, memory, age and label; a row whose reset is true starts anew and is itself inactive at 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        again = pdf["reset"].fillna(False).to_numpy(bool)
        part = np.cumsum(again)
        out = pdf[["ticker", "session"]].copy()
        out["memory"], out["age"], out["label"] = 0.0, 0.0, "inactive"
        for k in np.unique(part):
            at = (part == k) & ~again
            s, a, lab = remember(pdf["value"].to_numpy(float)[at])
            out.loc[at, "memory"], out.loc[at, "age"] = s, a
            out.loc[at, "label"] = lab
        return out

    inner = df.select("ticker", "session", F.col(value).cast("double").alias("value"), (F.col(reset) if reset else F.lit(False)).alias("reset"))
    return inner.groupBy("ticker").applyInPandas(run, "ticker string, session date, memory double, age double, label string")


def pivots(high: np.ndarray, low: np.ndarray, threshold: np.ndarray) -> list[tuple[int, int, str]]:
    """(place, place of confirmation, kind) of confirmed highs and lows; only sessions up to the confirmation count."""
    found: list[tuple[int, int, str]] = []
    trend, top, bottom = 0, 0, 0
    for i in range(1, len(high)):
        if high[i] > high[top]:
            top = i
        if low[i] < low[bottom]:
            bottom = i
        t = threshold[i]
        if np.isnan(t):
            continue
        if trend >= 0 and low[i] <= high[top] * (1 - t) and top < i:
            found.append((top, i, "high"))
            trend, bottom = -1, i
            top = i
        elif trend <= 0 and high[i] >= low[bottom] * (1 + t) and bottom < i:
            found.append((bottom, i, "low"))
            trend, top = 1, i
            bottom = i
    return found


def swings(close: np.ndarray, threshold: np.ndarray) -> list[tuple[int, int, str]]:
    """(place, place of confirmation, kind) of the swings of closes: a rise from the lowest close of a fall by the threshold confirms a low, a fall from the highest of a rise a high.

    Before the first swing both extremes count from the beginning, and a low goes first where both would be confirmed. A session without a threshold
    confirms nothing.
    """
    found: list[tuple[int, int, str]] = []
    leg, top, bottom = "", 0, 0
    for i in range(1, len(close)):
        x, t = close[i], threshold[i]
        if leg != "down" and x > close[top]:
            top = i
        if leg != "up" and x < close[bottom]:
            bottom = i
        if leg != "up" and close[bottom] and (x - close[bottom]) / close[bottom] >= t:
            found.append((bottom, i, "low"))
            leg, top = "up", i
        elif leg != "down" and close[top] and (close[top] - x) / close[top] >= t:
            found.append((top, i, "high"))
            leg, bottom = "down", i
    return found


def zigzag(df: DataFrame) -> DataFrame:
    """ticker, session of the swing and of its confirmation, kind and price, all of closes; the threshold is 1.5 mean ranges, from 3 to 10 percent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session").reset_index(drop=True)
        t = np.clip(1.5 * pdf["atr20"] / pdf["close"], 0.03, 0.10).to_numpy()
        got = swings(pdf["close"].to_numpy(float), t)
        return pd.DataFrame(
            {
                "ticker": [pdf["ticker"][0]] * len(got),
                "session": [pdf["session"][a] for a, _, _ in got],
                "confirmed": [pdf["session"][b] for _, b, _ in got],
                "kind": [k for _, _, k in got],
                "price": [float(pdf["close"][a]) for a, _, _ in got],
            }
        )

    return df.select("ticker", "session", "close", "atr20").groupBy("ticker").applyInPandas(run, "ticker string, session date, confirmed date, kind string, price double")


def _distribution_days(close: np.ndarray, volume: np.ndarray, window: int = 25, gain: float = 0.05) -> np.ndarray:
    """Distribution days that count at each session: falls of 0.2 percent on more volume, until they are `window` sessions old or the close is `gain` above theirs."""
    out = np.zeros(len(close), int)
    for i in range(len(close)):
        days = range(max(1, i - window + 1), i + 1)
        out[i] = sum(close[j] / close[j - 1] - 1 <= -0.002 and volume[j] > volume[j - 1] and (close[j + 1 : i + 1] < close[j] * (1 + gain)).all() for j in days)
    return out


def gate(pdf: pd.DataFrame, minimum_breadth: int = 20, minimum_sessions: int = 200) -> pd.DataFrame:
    """Market gate over two indices and the market's breadth, one row a session: state, rally day and last follow-through.

    pdf: session, lead and second close and volume (l_close, l_volume, s_close, s_volume), the shares of stocks above
    their means (above_ema20, above_sma50) and how many count (n). Where evidence lacks the state is `unavailable`; the
    machine stands still meanwhile and goes on from where it was.
    """
    pdf = pdf.sort_values("session").reset_index(drop=True)
    lc, lv, sc, sv = (pdf[c].astype(float) for c in ("l_close", "l_volume", "s_close", "s_volume"))
    e = pd.DataFrame({"c": lc, "ema": lc.ewm(span=20, adjust=False).mean(), "m50": lc.rolling(50).mean(), "m200": lc.rolling(200).mean(), "r5": lc / lc.shift(5) - 1, "r20": lc / lc.shift(20) - 1, "dd": lc / lc.shift(1).rolling(63).max() - 1})
    e = e.assign(sc=sc, sema=sc.ewm(span=20, adjust=False).mean(), sm50=sc.rolling(50).mean(), sm200=sc.rolling(200).mean(), be=pdf["above_ema20"].astype(float), bs=pdf["above_sma50"].astype(float))
    e["days"] = np.maximum(_distribution_days(lc.to_numpy(), lv.to_numpy()), _distribution_days(sc.to_numpy(), sv.to_numpy()))
    known = np.isfinite(e[["m200", "sm200", "r20", "dd", "be", "bs"]]).all(axis=1) & (pdf["n"] >= minimum_breadth) & (np.arange(len(e)) + 1 >= minimum_sessions)
    correction = (e.r5 <= -0.07) | ((e.c < e.m50) & ((e.r20 <= -0.05) | (e.dd <= -0.08) | (e.sc < e.sm50))) | ((e.days >= 5) & (e.c < e.ema))
    strong = (e.c > e.ema) & (e.ema > e.m50) & (e.c > e.m200) & (e.sc > e.sema) & (e.sc > e.sm50) & (e.be >= 0.55) & (e.bs >= 0.50) & (e.r20 > 0)
    pressure = (e.days >= 4) | ((e.c < e.ema).astype(int) + (e.sc < e.sema).astype(int) + (e.be < 0.50).astype(int) >= 2)
    recovery = (e.c > e.ema) & (e.c > e.m50) & (e.sc > e.sema) & (e.days <= 2) & (e.be >= 0.55)
    up = lc > lc.shift(1)
    follow = (lc / lc.shift(1) - 1 >= 0.015) & (sc / sc.shift(1) - 1 >= 0.015) & (lv > lv.shift(1)) & (sv > sv.shift(1))
    state, day, low, start, ftd, out = "range_bound", 0, None, None, None, []

    def fall(i: int) -> None:
        nonlocal state, day, low, start, ftd
        state, day, low, start, ftd = "market_in_correction", 0, lc[i], None, None

    for i in range(len(e)):
        if not known[i]:
            out.append(("unavailable", 0, None))
            continue
        if state == "market_in_correction":
            low = lc[i] if low is None else min(low, lc[i])
            if up[i]:
                state, day, start = "rally_attempt", 1, i
        elif state == "rally_attempt":
            if lc[i] < low or (correction[i] and not up[i]):
                fall(i)
            else:
                day += 1
                if 4 <= day <= 10 and follow[i]:
                    state, start, ftd = "confirmed_uptrend", None, pdf["session"][i]
                elif day > 10:
                    stale = float(lc[start : i + 1].min())
                    state, day, low, start = "market_in_correction", 0, stale, None
        elif correction[i]:
            fall(i)
        elif state == "confirmed_uptrend" and pressure[i]:
            state = "uptrend_under_pressure"
        elif (state == "uptrend_under_pressure" and recovery[i]) or (state == "range_bound" and strong[i]):
            state = "confirmed_uptrend"
        out.append((state, day, ftd))
    return pd.DataFrame({"session": pdf["session"], "state": [o[0] for o in out], "rally_day": [o[1] for o in out], "follow_through": [o[2] for o in out], "distribution_days": e["days"].astype("int64")})


def lifecycle(df: DataFrame, limit: int = 60) -> DataFrame:
    """Platform events of each ticker: opened when tight, then breakout, invalidated, near the pivot or expired.

    The id is a hash of ticker and start, so a longer history gives an event the same id.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        pdf = pdf.sort_values("session").reset_index(drop=True)
        rows, active = [], None
        for r in pdf.itertuples():
            if active is None:
                if r.tight_platform:
                    active = (hashlib.sha1(f"{r.ticker}|{r.session}".encode()).hexdigest()[:16], r.session, r.top, r.bottom, 0)
                    rows.append((r.ticker, active[0], r.session, "opened", r.top))
                continue
            name, start, top, bottom, age = active
            age += 1
            if r.close > top:
                rows.append((r.ticker, name, r.session, "breakout", top))
                active = None
            elif r.close < bottom:
                rows.append((r.ticker, name, r.session, "invalidated", top))
                active = None
            elif age >= limit:
                rows.append((r.ticker, name, r.session, "expired", top))
                active = None
            else:
                active = (name, start, top, bottom, age)
                if r.close >= 0.97 * top:
                    rows.append((r.ticker, name, r.session, "near_pivot", top))
        return pd.DataFrame(rows, columns=["ticker", "event", "session", "stage", "pivot_price"])

    return df.select("ticker", "session", "close", "tight_platform", "top", "bottom").groupBy("ticker").applyInPandas(run, "ticker string, event string, session date, stage string, pivot_price double")


def greedy_pairs(df: DataFrame, stratum: list[str], days: int = 63) -> DataFrame:
    """Matches each event to a control of its stratum that no earlier event took: the nearest by days, then by measure, session and ticker.

    df: the stratum's columns, ticker, session, is_event and measure. Events go by session and ticker. status tells matched
    ones from no_exact_stratum_control, outside_date_window and control_exhausted. A missing measure is infinitely far.
    Each stratum is one group, in which the order of events decides; so strata must be fine (fold, group, regime).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(day=pd.to_datetime(pdf["session"]).to_numpy().astype("datetime64[D]").astype(np.int64)).sort_values(["day", "ticker"])
        events, free = pdf[pdf["is_event"]], pdf[~pdf["is_event"]].reset_index(drop=True)
        day, measure, used = free["day"].to_numpy(), free["measure"].to_numpy(float), np.zeros(len(free), bool)
        rows = []
        for e in events.itertuples():
            # Controls are in order of day, so the window is a slice.
            a, b = np.searchsorted(day, [e.day - days, e.day + days + 1])
            open_ = a + np.flatnonzero(~used[a:b])
            pick, status = None, "no_exact_stratum_control" if not len(free) else "outside_date_window" if a == b else "control_exhausted"
            if len(open_):
                apart = np.abs(measure[open_] - e.measure)
                pick = open_[np.lexsort((open_, np.where(np.isfinite(apart), apart, np.inf), np.abs(day[open_] - e.day)))[0]]
                used[pick], status = True, "matched"
            rows.append((*(getattr(e, c) for c in stratum), e.ticker, e.session, *((None, None) if pick is None else (free["ticker"][pick], free["session"][pick])), status))
        return pd.DataFrame(rows, columns=[*stratum, "event_ticker", "session", "control_ticker", "control", "status"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in stratum)
    own = list(dict.fromkeys([*stratum, "ticker", "session", "is_event", "measure"]))
    return df.select(*own).groupBy(*stratum).applyInPandas(run, f"{kinds}, event_ticker string, session date, control_ticker string, control date, status string")


def isotonic(df: DataFrame, group: str) -> DataFrame:
    """Pool-adjacent-violators blocks of each group's (score, outcome): upper bound, mean and weight.

    Equal scores are summed by Spark before the groups meet, so a group is as long as it has distinct scores.
    """
    tied = df.groupBy(group, "score").agg(F.sum("outcome").alias("s"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        blocks: list[list[float]] = []
        for x, s, n in zip(pdf["score"], pdf["s"], pdf["n"]):
            blocks.append([x, float(s), float(n)])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                x2, s2, n2 = blocks.pop()
                blocks[-1] = [x2, blocks[-1][1] + s2, blocks[-1][2] + n2]
        return pd.DataFrame({group: pdf[group].iloc[0], "upper": [b[0] for b in blocks], "rate": [b[1] / b[2] for b in blocks], "n": [b[2] for b in blocks]})

    return tied.groupBy(group).applyInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, upper double, rate double, n double")
