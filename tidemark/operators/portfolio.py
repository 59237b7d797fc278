"""Portfolio replays: what can be bought is cut by Spark, each candidate's exit is found along its own ticker, and
one small walk over the calendar keeps the cash.

Cash is one state over all tickers, so the walk is sequential. It reads only the best candidates of each decision
session: at most twice as many as there are places can matter, since no more than all places are taken already. So
its rows depend on the calendar and the places, not on the universe.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import numbered_sessions
from tidemark.sources.storage import cut


@dataclass(frozen=True)
class Rules:
    """Buying and selling. Zero or None switches an exit off."""

    slots: int = 5
    weight: float = 0.20
    every: int = 5
    warmup: int = 60
    buy: float = 55.0
    sell: float | None = 40.0
    stop: float | None = 0.07
    take: float | None = 0.25
    trail: float | None = 0.10
    average: float | None = 0.98
    market: bool = True
    range_stop: float | None = None
    range_trail: float | None = None
    cost: float = 0.001
    least: float = 0.02
    core: float = 0.0
    trim: float = 0.0


#: The first engine's rules, and those of the core with satellites.
SINGLE = Rules()
SATELLITES = Rules(slots=8, weight=1 / 8, sell=None, stop=None, take=None, trail=None, average=None, market=False, range_stop=2.5, range_trail=3.0, core=0.5)


def calendar(market: DataFrame, rules: Rules) -> DataFrame:
    """market (session, open_, price, exposure) with k, the session's number, and decides: every so many after the warm-up."""
    days = numbered_sessions(market).withColumnRenamed("number", "k")
    return market.join(days, "session").withColumn("decides", (F.col("k") >= rules.warmup) & ((F.col("k") - rules.warmup) % rules.every == 0))


def candidates(bars: DataFrame, days: DataFrame, rules: Rules) -> DataFrame:
    """ticker and k of the best 2 * slots of each decision session by score (ties by ticker), where buying is allowed."""
    seen = Window.partitionBy("ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    grown = bars.withColumn("rows", F.count("*").over(seen)).where(F.col("rows") >= rules.warmup)
    open_days = days.where("decides").where("open_" if rules.market else "true").select("session", "k")
    able = grown.where((F.col("score") >= rules.buy) & (F.col("close") > 0)).join(F.broadcast(open_days), "session")
    best = Window.partitionBy("k").orderBy(F.desc("score"), "ticker")
    return able.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * rules.slots).select("ticker", "k", "score")


def holdings(bars: DataFrame, wanted: DataFrame, days: DataFrame, rules: Rules) -> DataFrame:
    """For each candidate: left (the session's number at which it is sold, null if held to the end), reason, and its closes,
    scores and trims at each session while it is held, from its entry on.

    Grouped by ticker: a group is one ticker's history and its candidates, which the calendar bounds. On sessions without a
    bar the last close stands. Exits are tested from the session after the entry, in the order stop, take, trail, average,
    ranges, market, score; the score only on decision sessions.
    """
    calendar_rows = [tuple(r) for r in days.select("k", "session", "open_", "decides").orderBy("k").collect()]  # a row a session
    when = {r[1]: r[0] for r in calendar_rows}
    open_, decides = (np.array([bool(r[i]) for r in calendar_rows]) for i in (2, 3))
    n = len(calendar_rows)
    schema = "ticker string, k long, score double, left long, reason string, closes array<double>, scores array<double>, trims array<boolean>"

    def run(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own[own["session"].isin(when)].sort_values("session")
        at = own["session"].map(when).to_numpy(int)
        filled = {}
        for c in ("close", "sma20", "atr20", "score"):
            line = np.full(n, np.nan)
            line[at] = own[c].to_numpy(float)
            place = np.full(n, -1)
            place[at] = at
            last = np.maximum.accumulate(place)
            filled[c] = np.where(last >= 0, line[np.maximum(last, 0)], np.nan)
        soon = np.zeros(n, bool)
        soon[at] = own["event_ahead"].fillna(False).to_numpy(bool)
        close, average, span, score = (filled[c] for c in ("close", "sma20", "atr20", "score"))
        rows = []
        for r in asked.itertuples():
            entry, first = close[r.k], r.k + 1
            later = np.arange(first, n)
            px, high = close[first:], np.maximum.accumulate(close[r.k :])[1:]
            wide = np.where(np.isfinite(span[first:]) & (span[first:] > 0), span[first:], 0.03 * px)
            none = np.zeros(len(px), bool)
            tests = [
                ("stop", px / entry - 1 <= -rules.stop if rules.stop else none),
                ("take", px / entry - 1 >= rules.take if rules.take else none),
                ("trail", px <= high * (1 - rules.trail) if rules.trail else none),
                ("average", px < average[first:] * rules.average if rules.average else none),
                ("range_stop", px <= entry - rules.range_stop * wide if rules.range_stop else none),
                ("range_trail", px <= high - rules.range_trail * wide if rules.range_trail else none),
                ("market", ~open_[first:] if rules.market else none),
                ("score", decides[first:] & (score[first:] < rules.sell) if rules.sell is not None else none),
            ]
            any_ = np.any([t for _, t in tests], axis=0)
            out = int(np.argmax(any_)) if any_.any() else None
            end = n if out is None else int(later[out]) + 1
            reason = None if out is None else next(name for name, t in tests if t[out])
            rows.append((r.ticker, r.k, r.score, None if out is None else int(later[out]), reason, close[r.k : end].tolist(), score[r.k : end].tolist(), soon[r.k : end].tolist()))
        return pd.DataFrame(rows, columns=["ticker", "k", "score", "left", "reason", "closes", "scores", "trims"]).astype({"left": "Int64"})

    columns = ["ticker", "session", "close", "sma20", "atr20", "score", "event_ahead"]
    mine = bars.join(wanted.select("ticker").distinct(), "ticker", "left_semi").select(*columns)
    return mine.groupBy("ticker").cogroup(wanted.groupBy("ticker")).applyInPandas(run, schema)


def walk(rows: list, days: list, rules: Rules, budget: float = 100_000.0) -> tuple[list, list]:
    """(equity, positions) by session, and the trades, of candidates and a calendar that Spark has cut.

    On each session exits come first, then purchases. With a core, `core` of the budget buys the market at the first
    session; the satellites' target is what is left of the equity times the session's exposure, and the weakest is sold
    where they stand 15 percent over it, once a decision session; purchases wait until they stand 15 percent under it.
    A position trims by `trim` on the session before an event and is filled up again after it.
    """
    by_day: dict[int, list] = {}
    for r in rows:
        by_day.setdefault(r["k"], []).append(r)
    cash, core, held, equity, trades = budget, 0.0, {}, [], []

    def price(r, k: int) -> float:
        return r["closes"][k - r["k"]]

    def sell(t: str, k: int, reason: str) -> None:
        nonlocal cash
        shares, r, _, _ = held.pop(t)
        cash += shares * price(r, k) * (1 - rules.cost)
        trades.append((t, r["k"], k, r["closes"][0], price(r, k), reason))

    for d in days:
        k, px = d["k"], d["price"]
        if k < rules.warmup:
            continue
        if rules.core and not core and px:
            core = budget * rules.core / (px * (1 + rules.cost))
            cash -= core * px * (1 + rules.cost)
        if rules.trim:
            for t, (shares, r, cut, since) in list(held.items()):
                if r["trims"][k - r["k"]] and not cut:
                    gone = shares * rules.trim
                    cash += gone * price(r, k) * (1 - rules.cost)
                    held[t] = (shares - gone, r, gone, k)
                elif cut and k > since:
                    need = cut * price(r, k) * (1 + rules.cost)
                    back = cut if cash >= need else 0.0
                    cash -= need if back else 0.0
                    held[t] = (shares + back, r, 0.0, since)
        for t in list(held):
            if held[t][1]["left"] == k:
                sell(t, k, held[t][1]["reason"])
        worth = lambda: sum(s * price(r, k) for s, r, _, _ in held.values())
        if d["decides"]:
            total = cash + core * (px or 0.0) + worth()
            target = total * (1 - rules.core) * (d["exposure"] if rules.core else 1.0)
            if rules.core and worth() > 1.15 * target and held:
                weakest = min(held, key=lambda t: (held[t][1]["scores"][k - held[t][1]["k"]], t))
                sell(weakest, k, "exposure")
            elif (d["open_"] or not rules.market) and (not rules.core or worth() < 0.85 * target):
                free = rules.slots - len(held)
                best = sorted((r for r in by_day.get(k, []) if r["ticker"] not in held), key=lambda r: (-r["score"], r["ticker"]))
                for r in best[: max(free, 0)]:
                    size = min((target if rules.core else total) * rules.weight, cash)
                    if size < total * rules.least:
                        continue
                    shares = size / (price(r, k) * (1 + rules.cost))
                    shares = float(int(shares)) if not rules.core else shares
                    if shares > 0:
                        cash -= shares * price(r, k) * (1 + rules.cost)
                        held[r["ticker"]] = (shares, r, 0.0, k)
        equity.append((d["session"], cash + core * (px or 0.0) + worth(), len(held)))
    return equity, trades


def replay(bars: DataFrame, market: DataFrame, rules: Rules = SINGLE, budget: float = 100_000.0) -> tuple[DataFrame, DataFrame]:
    """Equity (session, equity, positions) and trades (ticker, bought, sold, entry, exit, reason) of a portfolio.

    bars: ticker, session, close, score, sma20, atr20 and event_ahead; market: session, open_, price and exposure. A
    random choice of stocks is the same replay over a hashed score.
    """
    spark, days = bars.sparkSession, calendar(market, rules)
    # Written down: the candidates meet the bars that they come from.
    rows = holdings(bars, cut(candidates(bars, days, rules)).toDF("ticker", "k", "score"), days, rules)
    # A row a session, and 2 * slots rows a decision session.
    found, walked = rows.collect(), days.orderBy("k").collect()
    equity, trades = walk(found, walked, rules, budget)
    session = {d["k"]: d["session"] for d in walked}
    trades = [(t, session[a], session[b], float(x), float(y), reason) for t, a, b, x, y, reason in trades]
    return spark.createDataFrame(equity, "session date, equity double, positions long"), spark.createDataFrame(trades, "ticker string, bought date, sold date, entry double, exit double, reason string")
