"""Operators on hand-made tables: invariance, missing values, state, storage and streams."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, models, state
from tidemark.operators import layers as L
from tidemark.plans import layered
from tidemark.sources import bars as B
from tidemark.sources import storage
from tidemark.streaming import trades as T

DATA = "/root/testdata/sf0.001"


def history(n, close=None, ticker="AAA", **over):
    days = pd.bdate_range("2020-01-01", periods=n).date
    close = np.asarray(close if close is not None else 100 + np.arange(n) % 7, float)
    pdf = pd.DataFrame({"ticker": ticker, "session": days, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 1e6})
    return pdf.assign(**over)


def test_layers_do_not_look_ahead(spark):
    rng = np.random.default_rng(1)
    pdf = history(300, 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 300))))
    pdf["volume"] = rng.uniform(1e5, 1e6, 300)
    pdf["ema20"] = pdf["close"].ewm(span=20, adjust=False).mean()
    layers = [*layered.FULL, *L.CARRY, *L.CLIMAX, *L.PLATFORM]
    whole = L.stack(spark.createDataFrame(pdf), layers).drop("distress").orderBy("session").toPandas()
    for k in (150, 299):
        part = L.stack(spark.createDataFrame(pdf.iloc[:k]), layers).drop("distress").orderBy("session").toPandas()
        pd.testing.assert_frame_equal(part, whole.iloc[:k].reset_index(drop=True), check_dtype=False)


def test_windows_wait_until_full_and_false_differs_from_null(spark):
    out = L.stack(spark.createDataFrame(history(30)), [*L.PRESSURE, *L.TREND]).orderBy("session").collect()
    assert [r.sma20 is None for r in out] == [True] * 19 + [False] * 11
    assert out[0].vr is None and out[0].distribution is False and out[20].vr == 1.0
    flat = L.stack(spark.createDataFrame(history(5, [5.0] * 5, high=5.0, low=5.0)), L.PRESSURE).collect()
    assert all(r.cl is None and r.uw is None for r in flat)


def test_average_ranks(spark):
    from tidemark.functions.frames import rank_pct

    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None)], "session int, x double")
    got = sorted((r.x or 0, r.p) for r in df.selectExpr("x", f"{rank_pct('x', 'session')} AS p").collect())
    assert got == [(0, None), (5.0, 0.5), (5.0, 0.5), (7.0, 1.0)]


def test_risk_memory():
    s, a, lab = state.remember(np.array([5.0, 34, 15, 5]))
    assert lab == ["inactive", "new", "fading", "fading"] and a[-1] == 2 and s[-1] > 25
    s, _, _ = state.remember(np.array([40.0, 0, 0, 0, 0, 0]))
    assert s[-1] == pytest.approx(20.0)
    assert state.remember(np.array([np.nan, 40, 45]))[2] == ["unavailable", "new", "persistent"]
    assert state.remember(np.array([40.0] + [0] * 10))[0][-1] == 0


def test_ema_and_zigzag(spark):
    pdf = history(60)
    got = state.emas(spark.createDataFrame(pdf)).orderBy("session").toPandas()
    e = pdf["close"][0]
    for x, want in zip(pdf["close"][1:], got["ema20"][1:]):
        e += (x - e) * 2 / 21
        assert want == pytest.approx(e)
    high = np.array([1, 2, 3, 2.5, 2, 2.6, 3.5, 3.0])
    assert state.pivots(high, high, np.full(8, 0.1)) == [(0, 1, "low"), (2, 3, "high"), (4, 5, "low"), (6, 7, "high")]


def test_asof_and_visibility(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 5, "w")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50)], "k string, t int, q int")
    got = {r.v: (r.found_at, r.q) for r in asof.asof_backward(left, right, ["k"], "t", ["q"]).collect()}
    assert got == {"x": (None, None), "y": (5, 50), "z": (5, 50), "w": (None, None)}
    got = {r.v: r.q for r in asof.asof_backward(left, right, ["k"], "t", ["q"], 3).collect()}
    assert got["z"] is None
    for span in (1, 3, 100):
        assert sorted(map(str, asof.asof_backward(left, right, ["k"], "t", ["q"], span=span).collect())) == sorted(map(str, asof.asof_backward(left, right, ["k"], "t", ["q"]).collect()))
    v = spark.createDataFrame([("cpi", 1, 10, 3.0), ("cpi", 1, 20, 3.5), ("cpi", 2, 30, 4.0)], "series string, at int, known int, value double")
    assert [(r.at, r.value) for r in asof.latest_visible(v, ["series", "at"], "known", 25).collect()] == [(1, 3.5)]


def test_greedy_pairs_use_a_control_once(spark):
    d = lambda x: datetime.date(2020, 1, x)
    df = spark.createDataFrame([("a", d(10), True, 1.0), ("a", d(11), True, 1.0), ("a", d(12), False, 1.0), ("a", d(20), False, 5.0)], "ticker string, session date, is_event boolean, measure double")
    got = sorted((r.session.day, r.control.day) for r in state.greedy_pairs(df, ["ticker"]).collect())
    assert got == [(10, 12), (11, 20)]


def test_greedy_pairs_match_across_tickers_and_say_why_not(spark):
    d = lambda m, x: datetime.date(2020, m, x)
    rows = [("g", "a", d(1, 10), True, 1.0), ("g", "b", d(1, 11), False, 3.0), ("g", "c", d(1, 11), False, 2.0), ("g", "d", d(1, 12), True, None), ("g", "e", d(1, 13), True, 1.0), ("h", "a", d(1, 10), True, 1.0), ("h", "b", d(6, 10), False, 1.0), ("i", "a", d(1, 10), True, 1.0)]
    df = spark.createDataFrame(rows, "grp string, ticker string, session date, is_event boolean, measure double")
    got = {(r.grp, r.event_ticker): (r.control_ticker, r.status) for r in state.greedy_pairs(df, ["grp"]).collect()}
    assert got == {("g", "a"): ("c", "matched"), ("g", "d"): ("b", "matched"), ("g", "e"): (None, "control_exhausted"), ("h", "a"): (None, "outside_date_window"), ("i", "a"): (None, "no_exact_stratum_control")}


def test_isotonic_and_ridge(spark):
    df = spark.createDataFrame([("g", float(i), float(y)) for i, y in enumerate([0, 1, 0, 1, 1])], "grp string, score double, outcome double")
    got = [(r.upper, r.rate) for r in state.isotonic(df, "grp").orderBy("upper").collect()]
    assert got == [(0.0, 0.0), (2.0, 0.5), (4.0, 1.0)]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = x @ [1.0, -2.0] + 3 + rng.normal(size=200)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    got = {r.term: r.weight for r in models.ridge(rows, ["a", "b"], "y", 1.0).collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert got["intercept"] == pytest.approx(y.mean()) and [got["a"], got["b"]] == pytest.approx(want)


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.range(400).selectExpr("id % 40 AS block", "CAST(id % 10 AS DOUBLE) AS v")
    r = models.block_bootstrap(rows, "block", "v").first()
    assert r.low <= 4.5 <= r.high and abs(r["mean"] - 4.5) < 0.3


def test_validation_reasons(spark):
    ok = dict(ticker="a", date="2020-01-02", open=1.0, high=2.0, low=0.5, close=1.5, adjusted_close=1.5, volume=1.0)
    rows = [ok, {**ok}, {**ok, "date": None}, {**ok, "date": "x"}, {**ok, "date": "2020-01-03", "open": None}, {**ok, "date": "2020-01-04", "close": 0.0}, {**ok, "date": "2020-01-05", "volume": -1.0}, {**ok, "date": "2020-01-06", "high": 1.0}]
    got = storage.validate(spark.createDataFrame(rows, storage.PROVIDER_BARS))
    counts = {r.reason: r["count"] for r in got.groupBy("reason").count().collect()}
    assert counts == {None: 1, "duplicate_date": 1, "invalid_row": 1, "invalid_date": 1, "invalid_numeric": 1, "non_positive_price": 1, "negative_volume": 1, "invalid_ohlc": 1}
    assert storage.adjusted(got.where("reason IS NULL")).first().segment == 0


def test_validation_goes_by_the_source_order(spark):
    ok = dict(ticker="a", date="2020-01-02", open=1.0, high=2.0, low=0.5, close=1.5, adjusted_close=1.5, volume=1.0)
    rows = spark.createDataFrame([(0, *{**ok, "open": None}.values()), (1, *ok.values()), (2, None, None, *[1.0] * 6), (3, "a", "2020-13-01", *[1.0] * 6)], "source_index int, " + storage.PROVIDER_BARS.simpleString()[7:-1].replace(":", " "))
    got = {r.source_index: r.reason for r in storage.validate(rows, "source_index").collect()}
    assert got == {0: "invalid_numeric", 1: "duplicate_date", 2: "invalid_row", 3: "invalid_date"}
    got = {r.source_index: r.reason for r in storage.validate(rows).collect()}
    assert got[0] == "duplicate_date" and got[1] is None


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, storage.merged(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    twice = spark.createDataFrame([(2, "y", 2), (2, "z", 1), (None, "n", 1), (None, "m", 1)], "k int, v string, at int")
    assert sorted(map(tuple, storage.merged(old, twice, ["k"], "at").collect()), key=str) == [(1, "a"), (2, "y"), (None, "n")]
    assert sorted(map(tuple, storage.appended(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(ValueError):
        storage.ledger_append(old, new, ["k"])
    assert storage.ledger_append(old, old, ["k"]).count() == 2
    storage.replace_snapshot(old.selectExpr("k", "v", "1 AS day"), f"{tmp_path}/s", ["day"])
    storage.replace_snapshot(new.selectExpr("k", "v", "2 AS day"), f"{tmp_path}/s", ["day"])
    storage.replace_snapshot(new.selectExpr("k", "v", "1 AS day"), f"{tmp_path}/s", ["day"])
    assert spark.read.parquet(f"{tmp_path}/s").count() == 4
    storage.write_versioned(old, f"{tmp_path}/v")
    with pytest.raises(Exception):
        storage.write_versioned(old, f"{tmp_path}/v")
    assert storage.read_csv(spark, f"{tmp_path}/v", old.schema).count() == 2
    assert storage.content_path("x", {"a": 1, "b": 2}) == storage.content_path("x", {"b": 2, "a": 1})
    assert storage.markdown(old.orderBy("k")).splitlines()[2] == "| 1 | a |"


def test_zip_and_json_sources(spark, tmp_path):
    import json
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w") as z:
        z.writestr("one.json", json.dumps({"ticker": "a", "date": "2020-01-02", "open": 1.0}))
    got = storage.read_zipped_json(spark, f"{tmp_path}/a.zip", storage.PROVIDER_BARS).first()
    assert got.member == "one.json" and got.value.open == 1.0
    (tmp_path / "p.json").write_text(json.dumps([{"ticker": "a", "date": "2020-01-02", "open": 1.0}, {"ticker": "b"}]))
    assert storage.read_json(spark, f"{tmp_path}/p.json").count() == 2


def test_normaliser(spark):
    messages = [
        '{"T":"q","S":"AMD","t":"2026-07-24T14:30:00Z","bp":150.0,"bs":10,"ap":150.10,"as":12}',
        '{"T":"t","S":"amd","t":"2026-07-24T14:30:00.500000123Z","p":150.10,"s":100,"x":"V","i":42}',
        '{"T":"q","S":"AMD","t":"2026-07-24T14:30:01Z","bp":151.0,"bs":1,"ap":150.0,"as":1}',
        '{"T":"success"}',
    ]
    got = T.normalise(spark.createDataFrame([(m,) for m in messages], "value string")).collect()
    assert [r.reason for r in got] == [None, None, "invalid_quote", "control"]
    assert got[1].symbol == "AMD" and got[1].ns % 1_000_000_000 == 500000123 and got[0]["size"] == 2200
    trades = T.directions(T.normalise(spark.createDataFrame([(m,) for m in messages[:2]], "value string"))).first()
    assert (trades.direction, trades.method) == ("buy", "quote_mid")


def test_correction_chains(spark):
    trades = spark.createDataFrame([("s", 1, datetime.datetime(2020, 1, 1), i, 10.0, 1) for i in (1, 2, 3, 4)], "symbol string, ns long, event_ts timestamp, event_id long, price double, size long")
    changes = spark.createDataFrame([("s", 1, 11, 11.0), ("s", 11, 12, 12.0), ("s", 12, None, None), ("s", 2, 21, 21.0), ("s", 21, 22, 22.0), ("s", 3, None, None), ("other", 4, None, None)], "symbol string, old_id long, new_id long, price double")
    got = sorted((r.event_id, r.price) for r in T.effective(trades, changes).collect())
    assert got == [(2, 22.0), (4, 10.0)]


def test_long_correction_chains_and_loops(spark):
    at = datetime.datetime(2020, 1, 1)
    trades = spark.createDataFrame([("s", 1, at, i, 10.0, 1) for i in (1, 500, 600, 700)], "symbol string, ns long, event_ts timestamp, event_id long, price double, size long")
    chain = [("s", i, i + 1, float(i + 1)) for i in range(1, 40)]
    loops = [("s", 500, 501, 1.0), ("s", 501, 502, 2.0), ("s", 502, 500, 3.0), ("s", 600, 501, 4.0), ("s", 701, 701, 5.0)]
    got = [(r.event_id, r.price, r.replaced_by) for r in T.effective(trades, spark.createDataFrame(chain + loops, "symbol string, old_id long, new_id long, price double")).orderBy("event_id").collect()]
    assert got == [(1, 40.0, 40), (700, 10.0, None)]
    none = spark.createDataFrame([], "symbol string, old_id long, new_id long, price double")
    assert T.effective(trades, none).count() == 4


def test_duplicates_without_ids(spark):
    at = datetime.datetime(2020, 1, 1)
    e = spark.createDataFrame([("s", None, at, 1, "trade", 10.0, 1), ("s", None, at, 1, "trade", 11.0, 1), ("s", None, at, 801, "trade", 10.0, 1), ("s", 7, at, 1, "trade", 10.0, 1), ("s", 7, at, 1, "trade", 10.0, 1)], "symbol string, event_id long, event_ts timestamp, ns long, kind string, price double, size long")
    assert T.deduplicated(e.unionByName(e)).count() == 4


def test_streams_equal_batches(spark, tmp_path):
    events = B.market_events(spark, DATA)
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = T.minute_bars(stream.where("kind = 'trade'"), "3650 days").writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    want = T.minute_bars(events.where("kind = 'trade'"))
    assert sorted(map(tuple, spark.table("minutes").collect())) == sorted(map(tuple, want.collect()))
    doubled = events.union(events)
    assert T.deduplicated(doubled).count() == events.count()
    rows = events.withColumn("size", events["size"].cast("double"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/one")
    q = T.stream_directions(stream).writeStream.format("memory").queryName("sides").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.event_id: r.direction for r in T.directions(rows).collect()}
    assert {r.event_id: r.direction for r in spark.table("sides").collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_contraction_and_reasons(spark):
    from tidemark.operators import patterns

    rise = np.linspace(50, 100, 140)
    base = np.concatenate([rise, np.linspace(100, 82, 10), np.linspace(82, 98, 10), np.linspace(98, 88, 8), np.linspace(88, 97, 8), np.linspace(97, 93, 5), np.linspace(93, 96.5, 5)])
    got = patterns.contraction(base * 1.001, base * 0.999, base, np.full(len(base), 1e6), 0.03)
    assert got["stage"] in ("near_pivot", "forming") and got["n_legs"] >= 2 and got["first_depth"] > got["last_depth"]
    assert patterns.contraction(base[:50], base[:50], base[:50], base[:50], 0.03)["stage"] == "insufficient_history"
    assert patterns.contraction(base[::-1], base[::-1], base[::-1], base, 0.03)["stage"] == "below_ma50"
    rows = spark.createDataFrame(history(len(base), base).assign(atr20=1.0))
    out = patterns.contractions(rows).orderBy("session").collect()
    assert len(out) == len(base) and out[-1].stage == got["stage"]
    part = patterns.contractions(rows.limit(150).orderBy("session")).orderBy("session").collect()
    assert part == out[: len(part)]


def touches(spark, close, low=None, high=None, zone=(9.4, 9.6), **over):
    from tidemark.operators import patterns

    close = np.asarray(close, float)
    pdf = history(len(close), close, low=close if low is None else low, high=close if high is None else high).assign(atr20=1.0, mean_volume=5e5, lower=zone[0], upper=zone[1])
    got = patterns.support_touches(spark.createDataFrame(pdf), waiting=5, **over).orderBy("session").collect()
    return [(list(pdf["session"]).index(r.session), r.kind, r.delay, r.outcome, r.reclaim) for r in got]


def test_support_touch_outcomes(spark):
    ten = [10.0] * 3
    assert touches(spark, [*ten, 9.5, 9.7, 9.8, *[10.0] * 8])[0] == (0, "intersection", 3, "accepted", 1)
    assert touches(spark, [*ten, 9.3, 9.3, 9.8, *[10.0] * 8])[0] == (0, "gap_through", 3, "failed", 2)
    assert touches(spark, [*ten, 9.5, 9.5, 9.5, *[10.0] * 8])[0] == (0, "intersection", 3, "ambiguous", None)
    assert touches(spark, [*ten, 9.5, 8.8, 9.7, *[10.0] * 8])[0][3] == "failed"  # half a range under the zone
    assert touches(spark, [*ten, 9.0, 9.0, 9.0, *[10.0] * 8])[0][1:4] == ("gap_through", 3, "failed")
    # Untouched zones: the next episode begins after the waiting time, but not within ten sessions of the same zone.
    assert [x[0] for x in touches(spark, [10.0] * 30)] == [0, 10, 20] and touches(spark, [10.0] * 30)[0][1:] == (None, None, "not_touched", None)
    assert touches(spark, [14.0] * 30) == [] and touches(spark, [9.5] * 30) == []
    assert [x[0] for x in touches(spark, [10.0] * 30, apart=1)] == [0, 6, 12, 18]


def bottom_row(place, **over):
    from types import SimpleNamespace

    base = dict(place=place, downtrend=True, recent_downtrend=True, coverage=1.0, location=0.0, exhaustion=0.0, demand=0.0, higher_low=False, early_watch=False, any_breakout=False, follow_through=False, loud_low=False, close=10.0, invalidation=9.0)
    return SimpleNamespace(**{**base, **over})


def test_bottom_states_rise_hold_and_fail():
    from tidemark.operators import patterns

    walk = lambda rows: [(s, a, lv) for s, _, a, lv in patterns.bottom_walk(rows)]
    plain = [bottom_row(100 + i) for i in range(16)]
    up = bottom_row(99, location=15.0, exhaustion=10.0)
    assert walk([bottom_row(10, location=15.0)]) == [("unavailable", None, None)]
    got = walk([bottom_row(98, location=15.0), up, *plain])
    assert got[:2] == [("potential_support", 0, 9.0), ("seller_exhaustion_watch", 0, 9.0)]
    assert got[2:12] == [("seller_exhaustion_watch", k, 9.0) for k in range(1, 11)] and got[12] == ("downtrend_continuation", 0, None)
    # The level is frozen where the state was renewed; a close a hundredth under it fails, and that shows three sessions more.
    fall = bottom_row(101, close=8.9, invalidation=5.0)
    got = walk([up, fall, *plain[:5]])
    assert [g[0] for g in got] == ["seller_exhaustion_watch"] + ["bottom_failed"] * 4 + ["downtrend_continuation"] * 2 and [g[1] for g in got[1:5]] == [0, 1, 2, 3]
    assert [g[0] for g in walk([bottom_row(99, location=15.0), fall])] == ["potential_support", "potential_support"]
    assert walk([up, bottom_row(101, loud_low=True)])[1][0] == "bottom_failed"
    # A retest needs a bottom before it; without one the same evidence is support at most.
    retest = bottom_row(101, follow_through=True, location=15.0)
    assert walk([up, retest])[1][0] == "breakout_retest_confirmed" and walk([retest])[0][0] == "potential_support"
    assert walk([bottom_row(99, downtrend=False, recent_downtrend=False, location=15.0)])[0][0] == "unavailable"
    assert walk([bottom_row(99, coverage=0.4, location=15.0)])[0][0] == "unavailable"
    assert walk([bottom_row(99, higher_low=True, any_breakout=True)])[0][0] == "bullish_structure_confirmed"


def test_bottom_scores_by_hand(spark):
    from tidemark.operators import patterns

    n = 80
    pdf = history(n, 100 * 0.99 ** np.arange(n))
    pdf = pdf.assign(ema20=pdf["close"] * 1.05, support_lower=40.0, support_upper=pdf["close"] * 0.99, support_score=70.0, support_state="near", demand_score=60.0, demand_coverage=1.0, early_watch=True, higher_low=False, prior_high_breakout=False, trendline_breakout=False, market_state="rally_attempt")
    df = spark.createDataFrame(pdf).withColumn("demand_conditions", F.array(F.lit("seller_exhaustion"), F.lit("buyer_absorption")))
    r = patterns.bottom_scores(df).orderBy("session").collect()[-1]
    assert (r.location, r.exhaustion, r.demand, r.structure, r.environment, r.coverage) == (17.0, 18.0, 15.0, 5.0, 5.0, 1.0) and r.downtrend and r.score == 60.0
    cut = patterns.bottom_scores(df, ("location", "demand")).orderBy("session").collect()[-1]
    assert (cut.location, cut.demand, cut.coverage) == (0.0, 0.0, pytest.approx(0.6))
    far = patterns.bottom_scores(df.withColumn("support_upper", F.lit(10.0)).withColumn("market_state", F.lit("unavailable"))).orderBy("session").collect()[-1]
    assert far.location == pytest.approx(4.2) and far.environment == 0.0
    out = patterns.bottom_states(df).orderBy("session").collect()
    assert out[61].state == "unavailable" and out[62].state == "early_bullish_reversal_watch" and out[-1].invalidation == 40.0


def test_lifecycle_ids_do_not_depend_on_later_rows(spark):
    n = 30
    close = np.full(n, 10.0)
    close[20] = 12.0
    pdf = history(n, close).assign(tight_platform=[i == 10 for i in range(n)], top=11.0, bottom=9.0)
    whole = state.lifecycle(spark.createDataFrame(pdf)).orderBy("session").collect()
    assert [r.stage for r in whole] == ["opened", "breakout"]
    part = state.lifecycle(spark.createDataFrame(pdf.iloc[:15])).collect()
    assert part[0].event == whole[0].event


def flat_market(days, close=100.0, exposure=1.0):
    return pd.DataFrame({"session": days, "open_": True, "price": close, "exposure": exposure})


def scored(pdf, score):
    return pdf.assign(score=score, sma20=pdf["close"].rolling(20).mean(), atr20=2.0, event_ahead=False)


def test_backtest_exits_by_hand(spark):
    """One place; each ticker leaves for its own reason."""
    from tidemark.operators import portfolio

    rules = portfolio.Rules(slots=1, weight=1.0, every=1, warmup=3, cost=0.0, average=None, sell=None)
    for path, reason, day in (([10, 10, 10, 10, 9.4, 9.2], "stop", 5), ([10, 10, 10, 10, 12, 12.6], "take", 5), ([10, 10, 10, 10, 12, 10.7], "trail", 5)):
        pdf = scored(history(len(path), path, "AAA"), 60.0)
        bars, market = spark.createDataFrame(pdf), spark.createDataFrame(flat_market(pdf["session"]))
        equity, trades = portfolio.replay(bars, market, rules, 1000.0)
        t = trades.collect()
        assert [(r.reason, r.bought, r.sold, r.entry, r.exit) for r in t] == [(reason, pdf["session"][3], pdf["session"][day], 10.0, path[day])]
        assert equity.orderBy("session").collect()[-1].equity == pytest.approx(1000.0 * path[day] / 10)


def test_backtest_against_a_plain_replay(spark):
    """All tickers and all sessions walked in one loop, from the rules."""
    from tidemark.operators import portfolio

    rng = np.random.default_rng(4)
    n, frames = 140, []
    for k in range(12):
        pdf = history(n, 50 * np.exp(np.cumsum(rng.normal(0.001, 0.03, n))), f"T{k:02d}")
        frames.append(scored(pdf, 50 + rng.normal(0, 12, n)))
    pdf = pd.concat(frames)
    days = list(frames[0]["session"])
    ok = rng.random(n) > 0.1
    market = flat_market(days).assign(open_=ok)
    rules = portfolio.SINGLE
    equity, trades = portfolio.replay(spark.createDataFrame(pdf), spark.createDataFrame(market), rules)
    close, score, mean = (pdf.pivot(index="session", columns="ticker", values=c).to_numpy() for c in ("close", "score", "sma20"))
    names = sorted(set(pdf["ticker"]))
    cash, held, want, sold = 100_000.0, {}, [], 0
    for k in range(rules.warmup, n):
        decides = (k - rules.warmup) % 5 == 0
        for t in list(held):
            shares, entry, high = held[t]
            px = close[k, t]
            held[t] = (shares, entry, high := max(high, px))
            if px / entry - 1 <= -0.07 or px / entry - 1 >= 0.25 or px <= high * 0.9 or px < mean[k, t] * 0.98 or not ok[k] or (decides and score[k, t] < 40):
                cash += shares * px * 0.999
                del held[t]
                sold += 1
        if decides and ok[k]:
            total = cash + sum(s * close[k, t] for t, (s, _, _) in held.items())
            best = sorted((t for t in range(12) if t not in held and score[k, t] >= 55), key=lambda t: (-score[k, t], names[t]))
            for t in best[: 5 - len(held)]:
                size = min(total * 0.2, cash)
                shares = int(size / (close[k, t] * 1.001)) if size >= 0.02 * total else 0
                if shares:
                    cash -= shares * close[k, t] * 1.001
                    held[t] = (shares, close[k, t], close[k, t])
        want.append(cash + sum(s * close[k, t] for t, (s, _, _) in held.items()))
    assert [r.equity for r in equity.orderBy("session").collect()] == pytest.approx(want) and trades.count() == sold > 20


def test_core_satellite(spark):
    from tidemark.operators import portfolio

    n = 90
    up, down = history(n, 100 * 1.01 ** np.arange(n), "UP"), history(n, np.r_[np.full(70, 100.0), 100 * 0.97 ** np.arange(20)], "DOWN")
    bars = spark.createDataFrame(pd.concat([scored(up, 60.0), scored(down, 70.0)]))
    equity, trades = portfolio.replay(bars, spark.createDataFrame(flat_market(up["session"])), portfolio.SATELLITES)
    rows = equity.orderBy("session").collect()
    assert rows[0].equity == pytest.approx(100_000, rel=0.002) and max(r.positions for r in rows) == 2
    assert [(r.ticker, r.reason, r.entry) for r in trades.collect()][:1] == [("DOWN", "range_stop", 100.0)]


def test_slow_decline_rules_by_hand(spark):
    """Nine rules over a steady fall: all points but for what is unknown."""
    n = 80
    pdf = history(n, 100 * 0.99 ** np.arange(n), volume=1e6)
    pdf["ema20"] = pdf["close"].ewm(span=20, adjust=False).mean()
    pdf = pdf.assign(m_close=100.0, g_close=100.0)
    out = L.stack(spark.createDataFrame(pdf), [*layered.FULL, *L.RELATIVE, *L.DECLINE]).orderBy("session").collect()
    # No distribution days: that rule's 10 points of 100 are missed. Before session 60 the change over 60 lacks.
    assert out[-1].decline_score == 90.0 and out[60].decline_score == 90.0
    assert out[55].decline_score == pytest.approx(round(75 / 85 * 100, 2)) and out[10].decline_score is None


def test_climax_conditions_by_hand(spark):
    n = 100
    close = np.r_[np.full(60, 100.0), 100 * 1.03 ** np.arange(1, 41)]
    pdf = history(n, close, open=close * 0.999)
    pdf["volume"] = np.where(np.arange(n) >= 95, 5e6, 1e6)
    pdf["ema20"] = pdf["close"].ewm(span=20, adjust=False).mean()
    out = L.stack(spark.createDataFrame(pdf), [*layered.FULL, *L.CLIMAX]).orderBy("session").collect()
    assert out[59].climax_score == 0 and not out[59].climax_candidate and out[59].climax_conditions == ""
    last = out[-1]
    assert {"acceleration", "repeated_large_up_days", "ema_extension", "abnormal_volume"} <= set(last.climax_conditions.split(",")) and "repeated_gap_up" in last.climax_conditions
    assert last.climax_candidate and last.climax_score == 20 * len(last.climax_conditions.split(","))


def test_churn_waits_for_its_inputs(spark):
    out = L.stack(spark.createDataFrame(history(40)), [*L.PRESSURE, *L.COUNTS]).orderBy("session").collect()
    assert [r.churn is None for r in out] == [True] * 20 + [False] * 20
    assert [r.churn_10 is None for r in out] == [True] * 29 + [False] * 11


def test_labels_need_a_finite_path(spark):
    pdf = history(12)
    pdf.loc[6, "low"] = np.nan
    out = L.stack(spark.createDataFrame(pdf), L.labels(3)).orderBy("session").collect()
    assert [r.mature for r in out] == [i + 3 < 12 and not i < 6 <= i + 3 for i in range(12)]
    assert [r.reason for r in out] == [None if m.mature else "immature_future_path" if i + 3 >= 12 else "invalid_future_path" for i, m in enumerate(out)]
    assert all((r.fwd is None) == (r.mae is None) == (r.tail_up is None) == (not r.mature) for r in out)


def test_rating_is_rounded_half_to_even(spark):
    days = pd.bdate_range("2024-01-01", periods=260).date
    frames = [pd.DataFrame({"ticker": t, "session": days[-n:], "close": np.geomspace(100, 100 * k, n)}) for t, k, n in (("FAST", 2, 253), ("SLOW", 1.1, 253), ("SHORT", 3, 252))]
    got = {r.ticker: r.rating for r in L.stack(spark.createDataFrame(pd.concat(frames)), L.STRENGTH).where("strength IS NOT NULL").collect()}
    assert got == {"FAST": 99.0, "SLOW": 50.0}


def gate_history(lead, second=None, n=30, above=0.7, volume=None):
    days = pd.bdate_range("2020-01-01", periods=len(lead)).date
    lead = np.asarray(lead, float)
    volume = np.full(len(lead), 1e6) if volume is None else volume
    return pd.DataFrame({"session": days, "l_close": lead, "l_volume": volume, "s_close": lead if second is None else second, "s_volume": volume, "above_ema20": above, "above_sma50": above, "n": n})


def test_market_gate_states():
    rise = 100 * 1.002 ** np.arange(220)
    got = state.gate(gate_history(rise))
    assert list(got.state[:199]) == ["unavailable"] * 199 and set(got.state[199:]) == {"confirmed_uptrend"}
    assert set(state.gate(gate_history(rise, n=10)).state) == {"unavailable"}
    # A fall of 12 percent, then rises of 0.5 percent with one of 2 percent on more volume on the fifth rally day.
    fall = rise[-1] * np.array([0.96, 0.92, 0.88])
    rally = fall[-1] * np.cumprod([1.005, 1.005, 1.005, 1.005, 1.02, 1.002])
    path = np.r_[rise, fall, rally]
    volume = np.full(len(path), 1e6)
    volume[220 + 3 + 4] = 2e6
    got = state.gate(gate_history(path, volume=volume))
    assert list(got.state[220:]) == ["uptrend_under_pressure", "market_in_correction", "market_in_correction"] + ["rally_attempt"] * 4 + ["confirmed_uptrend", "market_in_correction"]
    assert list(got.rally_day[223:228]) == [1, 2, 3, 4, 5] and got.follow_through[227] == got.session[227] and got.follow_through.iloc[-1] is None
    # The second index must rise as much.
    second = path.copy()
    second[227:] = second[226]
    assert state.gate(gate_history(path, second, volume=volume)).state.iloc[227] == "rally_attempt"
    # While breadth lacks nothing moves; then the rally goes on from its day.
    gap = gate_history(path, volume=volume)
    gap.loc[225, "n"] = 0
    got = state.gate(gap)
    assert list(got.state[223:227]) == ["rally_attempt", "rally_attempt", "unavailable", "rally_attempt"] and list(got.rally_day[223:227]) == [1, 2, 0, 3]


def test_distribution_days_expire_and_are_removed():
    close = np.r_[100, 99, np.full(30, 99.0)]
    volume = np.r_[1.0, 2.0, np.full(30, 1.0)]
    got = state._distribution_days(close, volume)
    assert list(got) == [0] + [1] * 25 + [0] * 6
    close[5:] = 104.5
    assert list(state._distribution_days(close, volume))[:7] == [0, 1, 1, 1, 1, 0, 0]


def test_order_without_one_task(spark):
    from tidemark.operators import folds, order

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.integers(0, 40, 500), "y": rng.random(500) < 0.3})
    got = order.roc_auc(spark.createDataFrame(pdf), "x", "y").first()
    p, q = pdf.x[pdf.y].to_numpy(), pdf.x[~pdf.y].to_numpy()
    assert got.auc == pytest.approx(((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q))) and got.n_pos == len(p)
    assert order.roc_auc(spark.createDataFrame(pdf[pdf.y]), "x", "y").first().auc is None
    sizes = [r["count"] for r in order.tiles(spark.range(13).withColumnRenamed("id", "x"), ["x"], 5).groupBy("tile").count().orderBy("tile").collect()]
    assert sizes == [3, 3, 3, 2, 2]
    d = [datetime.date(2020, 1, k + 1) for k in range(12)]
    df = spark.createDataFrame([(d[k], d[k + 2] if k + 2 < 12 else None) for k in range(12)], "session date, label_end date")
    got = {(r.fold, r.role): r.n for r in folds.purged_folds(df, 4).groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "test"): 3, (2, "test"): 3, (3, "test"): 1, (1, "train"): 1, (2, "train"): 4, (3, "train"): 7}
    assert [r.n for r in folds.eligible(df, df).orderBy("session").collect()] == [max(0, k - 2) for k in range(12)]


def test_artifacts_codec_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", datetime.date(2020, 1, 1)), (2, None, None)], "k int, v string, d date")
    root = f"{tmp_path}/cache"
    paths = [storage.store_artifact(df, root, {"day": i}) for i in range(3)]
    assert storage.store_artifact(df, root, {"day": 0}) == paths[0]
    assert sorted(map(str, storage.load_artifact(spark, root, {"day": 1}).collect())) == sorted(map(str, df.collect())) and storage.load_artifact(spark, root, {"day": 9}) is None
    df.limit(1).write.mode("append").parquet(f"{paths[1]}/data")
    assert storage.load_artifact(spark, root, {"day": 1}) is None
    assert storage.prune_artifacts(spark, root, 1) == 2 and storage.load_artifact(spark, root, {"day": 2}).count() == 2
    coded = storage.encode_frame(df)
    assert sorted(map(str, storage.decode_frame(coded, df.schema).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception):
        storage.decode_frame(coded, df.schema, 10).collect()
    with pytest.raises(Exception):
        storage.decode_frame(coded, df.select("k").schema).collect()
    for version in (df, df.limit(1)):
        storage.publish(version, f"{tmp_path}/report")
        assert spark.read.json(f"{tmp_path}/report/json").count() == version.count() and spark.read.option("header", True).csv(f"{tmp_path}/report/csv").count() == version.count()
    with pytest.raises(Exception):
        storage.publish(df.selectExpr("raise_error('no') AS x"), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/json").count() == 1


def test_moving_blocks(spark):
    rows = spark.range(2000).selectExpr("date_add(DATE '2020-01-01', CAST(id div 10 AS INT)) AS session", "CAST(id % 10 AS DOUBLE) AS v")
    r = models.moving_block_bootstrap(rows, "session", "v", 20, 300).first()
    assert r.low <= 4.5 <= r.high and abs(r["mean"] - 4.5) < 0.1


def macro_vintages(spark):
    """The seven series around July 2026, with an inflation release that comes later."""
    at = lambda d, t="18:00:00": datetime.datetime.fromisoformat(f"{d}T{t}")
    day = datetime.date.fromisoformat
    months = {"2026-06-01": dict(DGS2=4.10, DGS10=4.00, DCOILWTICO=70.0, BAMLH0A0HYM2=3.2, VIXCLS=16.0, DTWEXBGS=120.0), "2026-07-01": dict(DGS2=4.75, DGS10=4.10, DCOILWTICO=84.0, BAMLH0A0HYM2=5.4, VIXCLS=28.0, DTWEXBGS=124.0)}
    rows = [(s, day(d), at(d), v, day("2026-07-01")) for d, vs in months.items() for s, v in vs.items()]
    rows += [("CPIAUCSL", day("2025-06-01"), at("2025-07-15"), 300.0, day("2025-07-15")), ("CPIAUCSL", day("2026-06-01"), at("2026-07-15"), 310.5, day("2026-07-15"))]
    rows += [("VIXCLS", day("2026-07-01"), at("2026-08-01"), 10.0, day("2026-08-01"))]  # a revision that must stay unseen
    return spark.createDataFrame(rows, "series_id string, observation_date date, available_at timestamp, value double, realtime_start date")


def test_macro_replay_sees_what_was_known(spark):
    from tidemark.operators import macro

    dates = spark.createDataFrame([(datetime.date.fromisoformat(d),) for d in ("2026-01-01", "2026-07-10", "2026-07-20", "2026-08-02")], "asof date")
    got = {str(r.asof): r for r in macro.risk(macro.values_at(macro_vintages(spark), dates)).collect()}
    assert got["2026-07-10"].CPI_YOY is None and got["2026-07-20"].CPI_YOY == pytest.approx(3.5) and got["2026-07-20"].DGS2 == 4.75
    # All known rules are met but the inverted curve, whose value is -0.65.
    assert got["2026-07-20"].score == 100.0 and got["2026-07-20"].coverage == 1.0 and got["2026-07-20"].state == "severe" and len(got["2026-07-20"].conditions) == 10
    assert got["2026-07-10"].coverage == 0.85 and got["2026-07-10"].inflation_energy_coverage == 0.4
    assert got["2026-08-02"].VIXCLS == 10.0 and got["2026-08-02"].score == 85.0 and got["2026-08-02"].risk_aversion_score == 25.0
    assert (got["2026-01-01"].score, got["2026-01-01"].state, got["2026-01-01"].DGS2) == (None, "unavailable", None)


def test_identity_ladder(spark):
    from tidemark.operators import identity

    d = datetime.date.fromisoformat
    names = ["isin", "type", "panel", "two", "former", "rivals", "ticker", "undated", "none", "late"]
    sample = spark.createDataFrame([(t, f"{t} Corp.", f"US{t}", "conflicting_isin" if t == "panel" else None, d("2001-01-01"), d("2003-01-01")) for t in names], "ticker string, name string, isin string, panel string, first_date date, last_date date")
    span = lambda t, a, b: [(f"{t.upper()} CORP", d(a), d(b))]
    register = spark.createDataFrame(
        [("1", "ISIN, Corp", "X", []), ("2", "Type Corp", "X", []), ("5", "Other", "X", span("former", "2002-01-01", "2004-01-01")), ("6", "Rivals Corp", "X", []), ("7", "rivals corp!", "X", []), ("8", "Something", " ticker", []), ("9", "Undated Corp", "X", []), ("10", "Other", "X", span("late", "2004-01-01", "2005-01-01"))],
        "cik string, name string, ticker string, former array<struct<name string, `from` date, `to` date>>",
    )
    evidence = spark.createDataFrame([("isin", "isin_cik", None, "usisin ", "1"), ("type", "security_type", "Preferred  Stock", None, None), ("isin", "security_type", " Common  STOCK", None, None), ("panel", "isin_cik", None, "USpanel", "3"), ("two", "isin_cik", None, "UStwo", "3"), ("two", "isin_cik", None, "UStwo", "4"), ("undated", "isin_cik", None, "USelse", "9")], "ticker string, key_type string, value string, isin string, cik string")
    got = {r.ticker: (r.cik, r.status, r.rule) for r in identity.adjudicate(sample, identity.name_candidates(sample, register), evidence).collect()}
    review = lambda rule: (None, "review_required", rule)
    assert got == {
        "isin": ("1", "confirmed", "isin_cik_plus_exact_name"), "type": (None, "rejected", "security_type_contradiction"), "panel": review("catalog_conflicting_isin"), "two": review("conflicting_isin_cik"),
        "former": ("5", "confirmed", "dated_former_name_overlap"), "rivals": review("competing_ciks"), "ticker": review("ticker_only_match"), "undated": review("undated_exact_name"), "none": (None, "unresolved", "no_identity_candidates"), "late": review("undated_exact_name"),
    }


def test_metric_rows_against_lists(spark):
    from tidemark.operators import evaluation

    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"spec": rng.choice(["a", "b"], n), "predicted_score": np.round(rng.random(n), 1), "actual_event": rng.random(n) < 0.3, "terminal_return": rng.normal(0, 1, n), "mae": -rng.random(n), "mfe": rng.random(n)})
    pdf["predicted_event"] = pdf["predicted_score"] > 0.6
    pdf["status"], pdf["mature"], pdf["lead_sessions"] = np.where(rng.random(n) < 0.9, "available", "missing"), rng.random(n) < 0.9, 2.0
    pdf.loc[len(pdf)] = ["c", 0.5, True, 0.0, -0.1, 0.1, True, "available", True, 1.0]
    got = {r.spec: r for r in evaluation.metric_rows(spark.createDataFrame(pdf), ["spec"]).collect()}
    assert got["c"].status == "insufficient" and got["c"].precision is None and got["c"].sample_count == 1
    for s in "ab":
        g = pdf[pdf.spec == s]
        v = g[(g.status == "available") & g.mature]
        p, a, x, r = v.predicted_event, v.actual_event, v.predicted_score.to_numpy(), got[s]
        assert (r.sample_count, r.excluded_unavailable_count, r.excluded_immature_count, r.signal_count) == (len(v), (g.status != "available").sum(), (~g.mature).sum(), p.sum())
        assert r.precision == pytest.approx((p & a).sum() / p.sum()) and r.balanced_accuracy == pytest.approx(((p & a).sum() / a.sum() + (~p & ~a).sum() / (~a).sum()) / 2)
        assert r.false_positive_opportunity_cost == pytest.approx(v.mfe[p & ~a].mean()) and r.mean_terminal_return == pytest.approx(v.terminal_return.mean())
        pos, neg = x[a], x[~a]
        assert r.roc_auc == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
        steps = [((x >= t) & a).sum() / (x >= t).sum() * ((x == t) & a).sum() / a.sum() for t in np.unique(x)]
        assert r.pr_auc == pytest.approx(sum(steps))


def test_gates_and_ablations(spark):
    from tidemark.operators import evaluation

    rows = [(g, "non_overlapping", f, s, "ok", 0.5 + 0.1 * (s == "new") * (f != 1)) for g in ("x", "y") for f in range(4) for s in ("base", "new")]
    metrics = spark.createDataFrame(rows, "scope string, sample_mode string, fold int, specification string, status string, balanced_accuracy double")
    compared = evaluation.compare_folds(metrics, ["scope", "sample_mode"], "base")
    assert {(r.scope, r.comparable_fold_count, r.fold_win_rate) for r in compared.collect()} == {("x", 4, 0.75), ("y", 4, 0.75)}
    assert evaluation.promotion_gate(metrics, compared, ["x", "y"], "base").first().passed
    assert evaluation.promotion_gate(metrics, compared, ["x", "z"], "base").first().reasons == ["required_group_evidence_missing"]
    assert evaluation.promotion_gate(metrics, compared.limit(0), ["x"], "base").first().reasons == ["paired_fold_evidence_missing"]
    assert evaluation.promotion_gate(metrics, compared.withColumn("fold_win_rate", F.lit(0.5)), ["x"], "base").first().reasons == ["fold_majority_not_won"]
    df = spark.createDataFrame([(1, 1.0, 10.0, 100.0)], "id int, a double, b double, c double")
    got = evaluation.ablations(df, {"ab": ["a", "b"], "c": ["c"]}, lambda v: sum((F.coalesce(x, F.lit(0.0)) for x in v.values()), F.lit(0.0)))
    assert {r.specification: r.score for r in got.collect()} == {"all": 111.0, "without_ab": 100.0, "without_c": 11.0}


def test_paired_evidence(spark):
    from tidemark.operators import evaluation

    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({"session": pd.bdate_range("2020-01-01", periods=n).date, "case_up": rng.normal(1, 1, n), "control_up": rng.normal(0, 1, n), "case_same": rng.normal(0, 1, n), "control_same": rng.normal(0, 1, n), "case_flat": 1.0, "control_flat": 0.0})
    got = {r.feature: r for r in evaluation.paired_evidence(spark.createDataFrame(pdf), ["up", "same", "flat"], resamples=300).collect()}
    d = pdf.case_up - pdf.control_up
    assert got["up"].admitted and got["up"].standardised == pytest.approx(d.mean() / d.std()) and got["up"].low < d.mean() < got["up"].high and got["up"].p < 0.05
    assert not got["same"].admitted and got["flat"].p is None and got["flat"].standardised is None and not got["flat"].admitted
    assert got["up"].q == pytest.approx(min(got["up"].p * 2, got["same"].p))


def test_transition_outcomes(spark):
    from tidemark.operators import evaluation

    pdf = history(8, [10, 10, 11, 12, 13, 14, 15, 16]).assign(state=["unavailable", "a", "a", "b", "unavailable", "a", "a", "b"])
    got = evaluation.transition_outcomes(spark.createDataFrame(pdf), (2,)).orderBy("session").collect()
    assert [(r.was, r.state) for r in got] == [("unavailable", "a"), ("a", "b"), ("unavailable", "a"), ("a", "b")]
    assert got[0].fwd_2 == pytest.approx(12 / 11 - 1) and got[0].mae_2 == pytest.approx(0.99 - 1) and got[0].mfe_2 == pytest.approx(12 * 1.01 / 11 - 1)
    assert got[2].fwd_2 == pytest.approx(16 / 15 - 1) and got[3].fwd_2 is None


def test_predictions_and_their_vetoes(spark):
    from tidemark.operators import rules

    rows = [("a", 85.0, True, 1.0, 1.2, True, 4.0, 90.0, False), ("b", 85.0, False, 1.0, 1.2, True, 4.0, 90.0, False), ("c", 92.0, True, 6.0, 1.2, True, None, 90.0, True), ("d", 80.0, True, 1.0, 0.8, True, 4.0, None, False), ("e", 50.0, True, None, None, False, 2.0, 90.0, False)]
    df = spark.createDataFrame(rows, "ticker string, total double, market_ok boolean, over_pivot double, volume_ratio double, breakout boolean, adr_20 double, rs double, gaps boolean")
    got = {r.ticker: (r.direction, r.up_probability, r.expected_move, r.confidence, r.vetoes) for r in L.stack(df, rules.PREDICTION).collect()}
    assert got == {
        "a": ("up", 0.66, 12.0, "high", ""), "b": ("weak_up", 0.55, 6.0, "medium", "market_not_confirmed"), "c": ("up", 0.5, 9.0, "low", "beyond_pivot"),
        "d": ("weak_up", 0.66, 6.0, "medium", "breakout_on_low_volume"), "e": ("weak_down", 0.42, -3.0, "high", ""),
    }


def test_technical_gate_and_regime(spark):
    from tidemark.operators import rules

    rise = state.with_emas(spark.createDataFrame(history(260, 100 * 1.002 ** np.arange(260))), (10, 20))
    out = L.stack(rise, rules.TECHNICAL_GATE).orderBy("session").collect()
    assert [out[i].technical_gate for i in (0, 100, 259)] == ["missing", "missing", "pass"] and out[100].passed_conditions == 3 and out[259].preferred_within_15pct
    fall = 100 * np.r_[1.002 ** np.arange(220), 1.002**219 * 0.97 ** np.arange(1, 21)]
    pdf = history(240, fall)
    index = state.with_emas(spark.createDataFrame(pdf.assign(s_close=pdf["close"])), (20,))
    got = [r.regime for r in L.stack(index, rules.REGIME).orderBy("session").collect()]
    assert got[:199] == ["unavailable"] * 199 and set(got[199:220]) == {"uptrend"} and got[-1] == "acute_selloff"
