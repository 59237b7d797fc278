"""Sinks, streams with state, quantiles, heads, factors, artifacts, intervals and scenarios on hand-made tables."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import assignments, evaluation, factors, frozen, order, patterns, scenarios, state, tails
from tidemark.plans import modelled
from tidemark.sources import batches, storage
from tidemark.streaming import processors
from tidemark.streaming import trades as S

AT = datetime.datetime(2020, 1, 1)
D = datetime.date


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ids_count_inside_their_kind(spark):
    e = spark.createDataFrame([("s", 7, AT, 1, "trade", 10.0, 1), ("s", 7, AT, 1, "quote", 10.0, 1), ("s", 7, AT, 2, "trade", 11.0, 1), (None, 7, AT, 1, "trade", 1.0, 1), (None, 7, AT, 1, "trade", 1.0, 1)], "symbol string, event_id long, event_ts timestamp, ns long, kind string, price double, size long")
    assert sorted(r.kind for r in S.deduplicated(e.unionByName(e)).collect()) == ["quote", "trade", "trade"]
    two = e.limit(1).withColumn("provider", F.lit("a")).unionByName(e.limit(1).withColumn("provider", F.lit("b")))
    assert S.deduplicated(two, by=("provider", "symbol")).count() == 2


def test_append_and_ledger_take_null_keys_as_equal(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    assert storage.appended(old, old, ["k"]).count() == 2
    assert storage.ledger_append(old, old, ["k"]).count() == 2
    assert rows_of(storage.ledger_append(old, spark.createDataFrame([(2, "c"), (2, "c")], old.schema), ["k"])) == [(1, "b"), (2, "c"), (None, "a")]
    for new in ([(2, "x"), (2, "y")], [(None, "z")], [(1, None)], [(None, "a"), (None, "q")]):
        with pytest.raises(ValueError, match="two payloads"):
            storage.ledger_append(old, spark.createDataFrame(new, old.schema), ["k"])
    keys_only = spark.createDataFrame([(1,)], "k long")
    assert storage.ledger_append(keys_only, keys_only, ["k"]).count() == 1


def test_validation_keeps_null_rows_apart(spark):
    bar = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    df = spark.createDataFrame([(None, "2020-01-02", *bar)] * 2 + [("a", None, *bar), ("a", "x", *bar), ("a", "2020-01-02", *bar), ("a", "2020-01-02", *bar)], storage.PROVIDER_BARS)
    got = storage.validate(df)
    assert sorted(r.reason or "" for r in got.collect()) == ["", "duplicate_date", "invalid_date", "invalid_row", "invalid_row", "invalid_row"]


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 500), "x": np.round(rng.normal(size=500), 1), "y": rng.normal(size=500)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0, float("nan")), (None, 2.0, None), ("d", None, None)], "g string, x double, y double"))
    got = {(r.g, r.name, r.share): (r.n, r.value) for r in order.exact_quantiles(df, ["x", "y"], [0.0, 0.1, 0.5, 1.0], ["g"]).collect()}
    for g in "abc":
        for c in "xy":
            own = pdf[pdf.g == g][c]
            for q in (0.0, 0.1, 0.5, 1.0):
                n, v = got[g, c, q]
                assert n == len(own) and v == pytest.approx(np.quantile(own, q))
    assert got[None, "x", 0.5] == (2, 1.5) and (None, "y", 0.5) not in got and ("d", "x", 0.5) not in got
    whole = order.exact_quantiles(df, ["y"], [0.25]).first()
    assert whole.value == pytest.approx(np.quantile(pdf.y, 0.25))
    assert order.exact_quantiles(df.limit(0), ["y"], [0.25], ["g"]).count() == 0


def test_ranks_by_group(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "s": np.round(rng.normal(size=400), 1), "y": rng.random(400) < 0.4})
    got = {r.g: r.auc for r in order.roc_auc(spark.createDataFrame(pdf), "s", "y", ["g"]).collect()}
    for g, own in pdf.groupby("g"):
        p, q = own[own.y].s.to_numpy(), own[~own.y].s.to_numpy()
        want = ((p[:, None] > q) + 0.5 * (p[:, None] == q)).mean()
        assert got[g] == pytest.approx(want)


def test_metric_rows_rank_without_a_window_by_group(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"spec": ["m"] * 200, "status": "available", "predicted_event": rng.random(200) < 0.5, "predicted_score": rng.normal(size=200), "actual_event": rng.random(200) < 0.4, "mature": True})
    for c in ("terminal_return", "mae", "mfe", "lead_sessions"):
        pdf[c] = 0.0
    found = evaluation.metric_rows(spark.createDataFrame(pdf), ["spec"])
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    p, q = pdf[pdf.actual_event].predicted_score.to_numpy(), pdf[~pdf.actual_event].predicted_score.to_numpy()
    assert found.first().roc_auc == pytest.approx((p[:, None] > q).mean())


def plain_heads(x, y, share, rounds=400):
    """The same majorisation by numpy."""
    m, s, u = x.mean(0), x.std(0), y.std()
    z, t = np.column_stack([np.ones(len(x)), (x - m) / s]), (y - y.mean()) / u
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        w = 1 / (np.abs(t - z @ b) + 1e-4)
        b = np.linalg.solve((z * w[:, None]).T @ z, (z * w[:, None]).T @ t + (2 * share - 1) * z.sum(0))
    return z @ b * u + y.mean()


def test_quantile_heads_equal_a_plain_fit_and_cover(spark):
    rng = np.random.default_rng(8)
    n = 3000
    x = rng.normal(size=(n, 2))
    y = 1 + x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) * (1 + 0.3 * x[:, 0])
    pdf = pd.DataFrame({"fold": np.arange(n) % 2, "a": x[:, 0], "b": x[:, 1], "c": 5.0, "y": y})
    df = spark.createDataFrame(pdf)
    train = df.unionByName(spark.createDataFrame([(0, None, 1.0, 5.0, 9.0), (1, 1.0, float("nan"), 5.0, 9.0)], df.schema))
    heads = tails.quantile_heads(train, ["a", "b", "c"], "y", [0.1, 0.5, 0.9], ["fold"], rounds=150, tolerance=1e-7)
    assert {(r.fold, r.share): r.weight for r in heads.where("term = 'c'").collect()} == {(f, q): 0.0 for f in (0, 1) for q in (0.1, 0.5, 0.9)}
    out = tails.quantile_predictions(df, heads, ["a", "b", "c"], ["fold"]).toPandas()
    for f, own in out.groupby("fold"):
        got = np.array([[q["value"] for q in r] for r in own.quantiles])
        assert (np.diff(got, axis=1) >= 0).all()
        want = np.sort(np.column_stack([plain_heads(own[["a", "b"]].to_numpy(), own.y.to_numpy(), share) for share in (0.1, 0.5, 0.9)]), 1)
        assert np.abs(got - want).max() < 5e-3
        for i, share in enumerate((0.1, 0.5, 0.9)):
            assert abs((own.y <= got[:, i]).mean() - share) < 0.02
    # Held out: fold 1's rows by fold 0's heads.
    other = tails.quantile_predictions(df.where("fold = 1").drop("fold"), heads.where("fold = 0").drop("fold"), ["a", "b", "c"]).toPandas()
    got = np.array([[q["value"] for q in r] for r in other.quantiles])
    assert all(abs((other.y <= got[:, i]).mean() - share) < 0.04 for i, share in enumerate((0.1, 0.5, 0.9)))
    assert tails.quantile_heads(df.limit(0), ["a"], "y", [0.5], ["fold"]).count() == 0


def test_crossing_quantiles_are_put_in_order(spark):
    heads = spark.createDataFrame([(0.1, "intercept", 2.0), (0.1, "x", 0.0), (0.9, "intercept", 0.0), (0.9, "x", 1.0)], "share double, term string, weight double")
    got = tails.quantile_predictions(spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double"), heads, ["x"]).collect()
    assert [None if r.quantiles is None else [q.value for q in r.quantiles] for r in got] == [[1.0, 2.0], [2.0, 5.0], None]


def test_tail_boundary(spark):
    ok = [(0.65, -0.1, -0.1, 0.1, 1.0, -0.2)] * 6 + [(0.45, -0.1, -0.1, 0.25, 0.0, -0.1)] * 4 + [(0.1, 0.1, 0.0, 0.9, 0.0, 0.1)] * 40
    odd = [(None, -0.1, -0.1, 0.1, 1.0, -0.2), (0.65, float("nan"), -0.1, 0.1, 1.0, -0.2), (0.65, -0.1, float("inf"), 0.1, 1.0, -0.2), (0.65, -0.1, -0.1, 0.1, 0.5, -0.2)]
    df = spark.createDataFrame(ok + odd, "down_probability double, median_return double, lower_return double, rebound_probability double, down_event double, terminal_return double")
    got = {(r.down_threshold, r.rebound_cap): r for r in tails.tail_boundary(df, minimum=6).collect()}
    assert len(got) == 6 and all(r.n == 50 for r in got.values())
    assert got[0.4, 0.3].risk_count == 10 and got[0.4, 0.3].down_precision == 0.6
    assert [k for k, r in got.items() if r.chosen] == [(0.6, 0.2)]  # equal precision: the greatest threshold, the least cap
    strict = {(r.down_threshold, r.rebound_cap): r.reasons for r in tails.tail_boundary(df, minimum=7, most=0.15).collect()}
    assert strict[0.6, 0.2] == ["insufficient_risk_rows"] and strict[0.4, 0.3] == ["excessive_risk_coverage"]
    risky = tails.tail_boundary(df.withColumn("terminal_return", F.lit(0.1)), minimum=1)
    assert not any(r.chosen for r in risky.collect()) and all("non_negative_risk_return" in r.reasons for r in risky.collect())
    assert tails.tail_boundary(df.limit(0)).count() == 0


def test_factor_registry(spark):
    day = D(2020, 1, 1)
    df = spark.createDataFrame([(t, day, v, t == "a") for t, v in zip("abcdef", (1.0, 2.0, 2.0, 4.0, float("nan"), 9.0))] + [("a", D(2020, 1, 2), 1.0, None)], "ticker string, session date, x double, up boolean")
    make = lambda key, direction, value, **over: factors.Factor(key, key, "g", direction, value, "1", **over)
    registry = factors.FactorRegistry([make("low", "lower", "x"), make("flag", "neutral", "up"), make("bad", "higher", "nothing + 1"), make("free", "neutral", "x", ranked=False)])
    with pytest.raises(ValueError, match="registered already"):
        registry.register(make("low", "higher", "x"))
    with pytest.raises(ValueError, match="direction"):
        make("odd", "sideways", "x")
    got = {(r.ticker, r.session.day, r.key): r for r in registry.evaluate(df).collect()}
    assert len(got) == 28
    low = [got[t, 1, "low"] for t in "abcdef"]
    assert [r.percentile for r in low] == [0.2, 0.5, 0.5, 0.8, None, 1.0] and low[0].display_score == 80.0 and low[0].peer_count == 5
    assert low[4].missing_reason == "missing_value" and low[4].raw is None
    assert got["a", 2, "low"].percentile is None and got["a", 2, "low"].peer_count == 1  # too few
    assert got["a", 1, "flag"].shown == "true" and got["a", 2, "flag"].missing_reason == "missing_value"
    assert all(got[t, 1, "bad"].missing_reason == "factor_error" for t in "abcdef")
    assert got["d", 1, "free"].raw == 4.0 and got["d", 1, "free"].percentile is None
    alone = {(r.ticker, r.session.day, r.key): r for r in factors.FactorRegistry([make("low", "lower", "x")]).evaluate(df).collect()}
    assert all(alone[k] == got[k] for k in alone)
    assert len(factors.BUILT_IN) == 19 and len({f.key for f in factors.BUILT_IN}) == 19


def test_all_factors_have_their_columns(spark):
    got = modelled.s211_all_factors(spark, "/root/testdata/sf0.001")
    reasons = {r.key: r.reasons for r in got.groupBy("key").agg(F.collect_set("missing_reason").alias("reasons")).collect()}
    assert len(reasons) == 19 and not any("factor_error" in r for r in reasons.values())


def intervals(spark, evidence, start=D(2020, 1, 1), observed=D(2021, 1, 1), priority=("override", "sec", "behaviour")):
    schema = "ticker string, source string, code string, effective_from date, effective_to date, observed_at date"
    members = spark.createDataFrame([("a", start, observed), ("b", start, observed)], "ticker string, history_start date, observed date")
    got = assignments.assignment_intervals(spark.createDataFrame(evidence, schema), members, list(priority), ["behaviour"])
    return [(r.effective_from, r.effective_to, r.source, r.code) for r in got.where("ticker = 'a'").orderBy("effective_from").collect()]


def test_assignment_intervals(spark):
    seen = D(2020, 6, 1)
    assert intervals(spark, []) == [(D(2020, 1, 1), None, "review", None)]
    # An override inside the register's record, which goes on behind it.
    got = intervals(spark, [("a", "sec", "tech", None, None, seen), ("a", "override", "x", D(2020, 3, 1), D(2020, 4, 1), seen)])
    assert got == [(D(2020, 1, 1), D(2020, 3, 1), "sec", "tech"), (D(2020, 3, 1), D(2020, 4, 1), "override", "x"), (D(2020, 4, 1), None, "sec", "tech")]
    # What was derived from behaviour is never backdated.
    assert intervals(spark, [("a", "behaviour", "c", None, None, seen)]) == [(D(2020, 1, 1), seen, "review", None), (seen, None, "behaviour", "c")]
    # Equal neighbours are one; a gap is in review; an end after the observation stays; records outside have no part.
    got = intervals(spark, [("a", "override", "x", D(2020, 2, 1), D(2020, 3, 1), seen), ("a", "override", "x", D(2020, 3, 1), D(2020, 4, 1), seen), ("a", "override", "y", D(2020, 5, 1), D(2022, 1, 1), seen), ("a", "sec", "old", D(2018, 1, 1), D(2019, 1, 1), seen), ("a", "sec", "new", D(2023, 1, 1), None, seen), ("a", "other", "z", None, None, seen)])
    assert got == [(D(2020, 1, 1), D(2020, 2, 1), "review", None), (D(2020, 2, 1), D(2020, 4, 1), "override", "x"), (D(2020, 4, 1), D(2020, 5, 1), "review", None), (D(2020, 5, 1), None, "override", "y")]
    with pytest.raises(ValueError, match="overlapping"):
        intervals(spark, [("a", "sec", "p", D(2020, 2, 1), None, seen), ("a", "sec", "q", D(2020, 3, 1), D(2020, 4, 1), seen)])


def test_frozen_artifacts(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, float("inf")), ("c", -1e300, 0.0)], "ticker string, x double, y double")
    whole = [("r", "ridge", "", "x", 0.5, 0.0, 2.0, 4.0, 0.1, 0.5, 0.2), ("r", "ridge", "", "y", 1.0, 1.0, 1.0, -1.0, 0.1, 0.5, 0.2), ("b", "binary_logistic", "1", "x", 0.0, 0.0, 1.0, 1.0, 0.0, 0.5, 0.0)]
    make = lambda r: spark.createDataFrame(r, frozen.ARTIFACT)
    got = {(r.ticker, r.version): r for r in frozen.score(rows, make(whole), ["ticker"]).collect()}
    assert len(got) == 6  # two versions in one pass
    assert got["a", "r"].predicted_return == pytest.approx(0.1 + 4 * 0.5 - 1) and got["a", "r"].predicted_direction == "up"
    assert got["b", "r"].predicted_return == pytest.approx(0.1 + 4 * 0.25) and got["b", "b"].predicted_score == 0.5 and got["b", "b"].predicted_event
    assert got["c", "b"].predicted_score == pytest.approx(1 / (1 + np.exp(35)))
    three = [("d", "direction_logistic", c, "x", 0.0, 0.0, 1.0, w, 0.0, 0.5, 0.0) for c, w in (("down", -1.0), ("neutral", 0.0), ("up", 1.0))]
    r = {r.ticker: r for r in frozen.score(rows, make(three), ["ticker"]).collect()}
    assert r["a"].predicted_direction == "up" and r["c"].predicted_event and r["b"].predicted_direction == "down"  # a tie: the first name
    for bad in ([*whole, whole[0]], [("r", "ridge", "", "x", 0.5, 0.0, 0.0, 4.0, 0.1, 0.5, 0.2)], [("r", "tree", *whole[0][2:])], three[:2], [(*whole[0][:7], float("nan"), *whole[0][8:])]):
        with pytest.raises(ValueError, match="hold together"):
            frozen.score(rows, make(bad), ["ticker"])
    with pytest.raises(ValueError, match="lack features"):
        frozen.score(rows.drop("y"), make(whole), ["ticker"])


def test_shadow_ledger(spark):
    said = spark.createDataFrame([("v1", "a", D(2020, 1, 1), 5, 0.2), ("v2", "a", D(2020, 1, 1), 5, 0.4)], "version string, ticker string, observation_date date, horizon int, predicted_score double")
    ledger = frozen.record(said.limit(0), said)
    assert frozen.record(ledger, said).count() == 2
    with pytest.raises(ValueError, match="two payloads"):
        frozen.record(ledger, said.withColumn("predicted_score", F.lit(0.9)))
    came = said.where("version = 'v1'").drop("predicted_score").withColumn("actual", F.lit(1.0))
    matured = frozen.mature(ledger, came, came.limit(0))
    assert frozen.mature(ledger, came, matured).count() == 1
    with pytest.raises(ValueError, match="two payloads"):
        frozen.mature(ledger, came.withColumn("actual", F.lit(0.0)), matured)
    with pytest.raises(ValueError, match="without a prediction"):
        frozen.mature(ledger, came.withColumn("ticker", F.lit("z")), matured)


def test_scenarios(spark):
    days = pd.bdate_range("2020-01-01", periods=200).date
    close = 100 * 1.001 ** np.arange(200) * (1 + 0.01 * (np.arange(200) % 3))
    rows = [("a", d, float(c)) for d, c in zip(days, close)] + [("short", d, 1.0 + i) for i, d in enumerate(days[:30])] + [("bad", d, 0.0 if i == 3 else 1.0) for i, d in enumerate(days)]
    bands = scenarios.scenario_bands(spark.createDataFrame(rows, "ticker string, session date, close double"), (20, 60))
    got = {(r.ticker, r.horizon): r for r in bands.collect()}
    samples = [close[e] / close[e - 20] - 1 for e in range(199, 19, -20)]
    vol = np.std(np.diff(close)[-63:] / close[:-1][-63:], ddof=1) * np.sqrt(252)
    cap = 3 * vol * np.sqrt(20 / 252)
    r = got["a", 20]
    assert r.sample_count == 9 and (r.pessimistic, r.median, r.optimistic) == pytest.approx(tuple(np.clip(np.quantile(samples, [0.25, 0.5, 0.75]), -cap, cap)))
    assert got["a", 60].missing_reason == "insufficient_samples" and got["a", 60].sample_count == 3
    assert got["short", 20].missing_reason == "insufficient_samples" and got["bad", 20].missing_reason == "invalid_close_history"
    paths = scenarios.scenario_paths(bands).where("ticker = 'a' AND scenario = 'median'").orderBy("step").collect()
    assert len(paths) == 21 and paths[0].price == close[-1] and paths[20]["return"] == pytest.approx(r.median)


CHANGES = "symbol string, kind string, event_id long, old_id long, new_id long, ns long, price double, size double"


def test_effective_trades_in_any_order(spark, tmp_path):
    """The log's final table equals the batch operator's on the same events, however they come."""
    rng = random.Random(7)
    trades = [("s", "trade", i, None, None, i, 10.0 + i, 1.0) for i in range(1, 13)] + [("t", "trade", 1, None, None, 1, 5.0, 1.0)]
    changes = [("s", "correction", None, i, 100 + i, 0, 50.0 + i, 0.0) for i in range(1, 8)] + [("s", "correction", None, 101, 201, 0, 71.0, 0.0), ("s", "correction", None, 201, 301, 0, 72.0, 0.0), ("s", "cancel", None, 102, None, 0, None, 0.0), ("s", "cancel", None, 9, None, 0, None, 0.0)]
    changes += [("s", "correction", None, 3, 150, 0, 99.0, 0.0), ("s", "cancel", None, 4, None, 0, None, 0.0), ("s", "correction", None, 105, 5, 0, 1.0, 0.0), ("t", "cancel", None, 77, None, 0, None, 0.0)]
    batch = lambda rows: spark.createDataFrame(rows, CHANGES)
    links = batch(changes).select("symbol", "old_id", "new_id", "price")
    base = batch(trades).select("symbol", "ns", F.lit(AT).alias("event_ts"), "event_id", "price", "size")
    want = rows_of(S.effective(base, links).select("symbol", "event_id", "price", "replaced_by"))
    for k in range(2):
        rows = trades + changes + rng.sample(trades + changes, 6)  # some come twice
        rng.shuffle(rows)
        log = modelled.streamed(batch(rows).repartition(3), processors.effective_stream, f"effective{k}")
        got = rows_of(processors.effective_now(log).select("symbol", "event_id", "price", "replaced_by"))
        assert got == want
        assert log.where("op = 'delete'").count() <= log.count()


def test_liveness_falls_step_by_step(spark, tmp_path):
    at = lambda minutes: AT + datetime.timedelta(minutes=minutes)
    schema = "symbol string, kind string, event_ts timestamp"
    rows = [("quiet", "trade", at(0)), ("loud", "trade", at(0)), ("asked", "subscribe", at(0)), ("back", "trade", at(1)), ("loud", "quote", at(9)), ("loud", "trade", at(30)), ("loud", "trade", at(60)), ("back", "trade", at(60)), ("loud", "trade", at(61))]
    frames = [spark.createDataFrame([r], schema) for r in rows]
    seen = []
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, processors.ROCKSDB)
    root = f"{tmp_path}/live"
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = processors.liveness_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), 10 * 60_000, 20 * 60_000, "2 minutes")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).foreachBatch(lambda out, b: seen.extend((r.symbol, r.state) for r in sorted(out.collect(), key=lambda r: r.at_ms))).start()
    q.awaitTermination()
    spark.conf.set(store, before)
    of = lambda s: [x for t, x in seen if t == s]
    assert of("quiet") == ["live", "stale", "disconnected"]
    assert of("asked") == ["pending", "stale", "disconnected"]
    assert of("back") == ["live", "stale", "live"]
    assert of("loud") == ["live"]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    schema = T.StructType.fromDDL("k long, v string")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, n int")
    table = batches.BatchTable(spark, f"{tmp_path}/t", schema, ["k"], 4)
    take = table.upsert("n")
    take(frame([(1, "a", 1), (2, "b", 1), (None, "x", 1)]), 0)
    take(frame([(1, "c", 2), (1, "d", 3), (3, "e", 1), (None, "y", 1)]), 1)
    want = [(1, "d"), (2, "b"), (3, "e"), (None, "y")]
    assert rows_of(table.read()) == want
    take(frame([(1, "again", 9)]), 1)
    take(frame([(1, "old", 9)]), 0)
    assert rows_of(table.read()) == want and table.batches() == [0, 1]
    # Killed between the write and the commit: the data is there, the table is as it was; the batch comes again.
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            take(frame([(2, "z", 1), (7, "w", 1)]), 2)
    assert rows_of(table.read()) == want
    batches.BatchTable(spark, f"{tmp_path}/t", schema, ["k"], 4).upsert("n")(frame([(2, "z", 1), (7, "w", 1)]), 2)
    assert rows_of(table.read()) == [(1, "d"), (2, "z"), (3, "e"), (7, "w"), (None, "y")]
    take(frame([]), 3)
    assert table.batches() == [0, 1, 2, 3] and table.read().count() == 5


def test_appending_stream_sink(spark, tmp_path):
    schema = T.StructType.fromDDL("k long, v string")
    table = batches.BatchTable(spark, f"{tmp_path}/t", schema, ["k"], 4)
    frames = [spark.createDataFrame(r, schema) for r in ([(1, "a"), (None, "n")], [(1, "b"), (2, "c"), (2, "c"), (None, "m")], [])]
    modelled.in_batches([f for f in frames[:2]], table.append())
    assert rows_of(table.read()) == [(1, "a"), (2, "c"), (None, "n")]
    table.append()(frames[1], 1)
    assert table.read().count() == 3


def plain_contraction(high, low, close, volume, threshold):
    """Every base walked by itself."""
    n, price = len(close), close[-1]
    if n < 60:
        return {"stage": "insufficient_history"}
    mean50 = close[-50:].mean()
    if price <= mean50:
        return {"stage": "below_ma50"}
    if n >= 200 and mean50 < close[-200:].mean():
        return {"stage": "long_trend_not_rising"}
    best, swung = None, False
    for length in range(20, min(80, n) + 1):
        h, lo, c = high[-length:], low[-length:], close[-length:]
        if (h.max() - lo.min()) / h.max() > 0.35 or (c[-1] / c[0] - 1 > 0.15 and abs(c[-1] - c[0]) > 0.5 * np.abs(np.diff(c)).sum()):
            continue
        marks = [(place, kind) for place, _, kind in state.pivots(c, c, np.full(length, threshold))]
        falls = [(a, b, (h[a] - lo[b]) / h[a] * 100) for (a, x), (b, y) in zip(marks, marks[1:]) if (x, y) == ("high", "low")]
        falls = [f for f in falls if f[2] >= 2][-4:]
        if len(falls) < 2:
            continue
        swung = True
        d = [x for _, _, x in falls]
        if any(b > 0.95 * a for a, b in zip(d, d[1:])) or d[-1] > 0.75 * d[0] or d[0] - d[-1] < 3:
            continue
        score = (len(falls), -d[-1] / d[0], -(h[-10:].max() - lo[-10:].min()) / price * 100, falls[-1][1] - length, -length)
        if best is None or score > best[0]:
            best = (score, length, len(falls), float(h[falls[-1][0]]))
    if best is None:
        return {"stage": "contractions_not_decreasing" if swung else "insufficient_swings"}
    return {"base": best[1], "n_legs": best[2], "pivot": best[3]}


def test_contractions_equal_walking_every_base():
    rng = np.random.default_rng(11)
    met = set()
    for k in range(60):
        n = int(rng.integers(55, 260))
        close = 100 * np.exp(np.cumsum(rng.normal(0.002, 0.02, n)) * (1 if k % 3 else 0.7))
        if k % 2:  # falls that shrink towards the end
            tail = min(70, n - 1)
            close[-tail:] = close[-tail - 1] * (1 - np.linspace(0.18, 0.01, tail) * np.abs(np.sin(np.arange(tail) / rng.uniform(5, 8))) + rng.normal(0, 0.002, tail) + 0.03)
        high, low, volume = close * 1.006, close * 0.994, rng.uniform(1, 2, n)
        for end in range(50, n + 1, 3):
            s = slice(max(0, end - 200), end)
            t = float(rng.choice([0.03, 0.05, 0.08]))
            got = patterns.contraction(high[s], low[s], close[s], volume[s], t)
            want = plain_contraction(high[s], low[s], close[s], volume[s], t)
            met.add(got["stage"])
            for name, value in want.items():
                assert got[name] == value
            assert "base" in want or "base" not in got
    assert {"below_ma50", "insufficient_history", "insufficient_swings", "contractions_not_decreasing"} < met and met & {"near_pivot", "forming", "breakout", "extended"}


def test_every_stage_occurs_on_the_walked_bars(spark):
    got = {r[0] for r in modelled.stateful.x06b_contractions_daily(spark, "/root/testdata/sf0.01").select("stage").distinct().collect()}
    assert {"insufficient_history", "below_ma50", "long_trend_not_rising", "insufficient_swings", "contractions_not_decreasing", "forming", "near_pivot", "breakout"} <= got


def test_swings_are_of_closes(spark):
    close = np.array([100, 101, 100.5, 104.5, 106, 102, 101, 105, 107, 103.0])
    assert state.swings(close, np.full(10, 0.03)) == [(0, 3, "low"), (4, 5, "high"), (6, 7, "low"), (8, 9, "high")]
    assert state.swings(close, np.full(10, np.nan)) == [] and state.swings(close[:1], np.full(1, 0.03)) == []
    days = pd.bdate_range("2020-01-01", periods=10).date
    df = spark.createDataFrame([("a", d, float(c), 2.0) for d, c in zip(days, close)], "ticker string, session date, close double, atr20 double")
    assert [(r.kind, r.price, r.confirmed) for r in state.zigzag(df).orderBy("confirmed").collect()] == [("low", 100.0, days[3]), ("high", 106.0, days[5]), ("low", 101.0, days[7]), ("high", 107.0, days[9])]
    rows = patterns.trendlines(df).orderBy("session").collect()
    assert [r.higher_low for r in rows] == [False] * 7 + [True] + [False] * 2 and all(r.line is None for r in rows)
    falling = np.array([100, 110, 104, 108.5, 103, 99, 96, 100, 103, 108.0])
    df = spark.createDataFrame([("a", d, float(c), 2.0) for d, c in zip(days, falling)], "ticker string, session date, close double, atr20 double")
    rows = patterns.trendlines(df).orderBy("session").collect()
    assert rows[8].line == pytest.approx(108.5 - 0.75 * 5) and [r.breakout for r in rows] == [False] * 9 + [True]


def test_archive_members_are_partitions(spark, tmp_path):
    import json
    import zipfile

    from tidemark.sources import archives

    for a in ("one", "two"):
        with zipfile.ZipFile(f"{tmp_path}/{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(30):
                z.writestr(f"sub/{i}.json", json.dumps({"cik": i, "name": f"{a} {i} é", "pad": "x" * (i * 100)}))
            z.writestr("odd.json", "not json")
            z.writestr("readme.txt", "no member")
    with zipfile.ZipFile(f"{tmp_path}/none.zip", "w"):
        pass
    paths = [f"{tmp_path}/{a}.zip" for a in ("one", "two", "none")]
    df = archives.read_members(spark, paths, "cik long, name string", partition_bytes=500)
    assert df.rdd.getNumPartitions() > 6
    got = df.collect()
    assert len(got) == 62 and {(r.value.cik, r.value.name) for r in got if r.member != "odd.json"} == {(i, f"{a} {i} é") for a in ("one", "two") for i in range(30)}
    assert all(r.value is None or r.value.cik is None for r in got if r.member == "odd.json")
    assert archives.read_members(spark, paths[2:], "cik long").count() == 0


def test_decision_ladder(spark):
    from tidemark.operators import decision

    schema = "id int, raw_direction string, immediate_score double, known boolean, individual_score double, group_score double, slow_decline_score double, score double, top_state string, top_raw_state string, sources array<string>"
    calm = (10.0, True, 5.0, 5.0, 5.0, 5.0)
    rows = [
        (1, "up", 70.0, False, None, None, None, None, None, None, None),
        (2, "up", *calm, "confirmed", "confirmed", ["group"]),
        (3, "up", 40.0, True, None, 60.0, None, 0.0, "low", "low", ["group"]),
        (4, "up", 39.0, True, None, 60.0, None, 0.0, "low", "low", ["group"]),
        (5, "down", 0.0, True, 30.0, None, None, 0.0, "low", "low", []),
        (6, "up", *calm, "fading", "low", []),
        (7, "up", 0.0, True, 20.0, None, None, 90.0, "low", "low", ["individual"]),
        (8, "up", 0.0, True, None, None, None, 30.0, "low", "low", []),
        (9, "up", 0.0, True, 0.0, None, 49.0, 90.0, "low", "low", ["x"]),
        (10, "up", None, False, 99.0, None, None, 99.0, "confirmed", "confirmed", ["x"]),
        (11, "unavailable", 99.0, True, 99.0, None, None, 99.0, "low", "low", ["x"]),
        (12, "neutral", 0.0, True, None, None, 70.0, 0.0, "confirmed", "high", []),
    ]
    got = {r.id: (r.risk_state, r.final_direction, r.action, ",".join(r.reasons)) for r in decision.decide(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("confirmed", "down", "override_to_down", "immediate_bearish_confirmation")
    assert got[2] == ("confirmed", "down", "override_to_down", "high_level_distribution_risk,high_level_structure_damage_confirmation,group_bearish_risk")
    assert got[3] == ("confirmed", "down", "override_to_down", "persistent_bearish_risk,persistent_immediate_confluence,group_bearish_risk")
    assert got[4] == ("high", "neutral", "downgrade_to_neutral", "persistent_bearish_risk,group_bearish_risk")
    assert got[5] == ("high", "down", "retain", "persistent_bearish_risk")
    assert got[6] == ("high", "neutral", "downgrade_to_neutral", "high_level_distribution_risk")
    assert got[7] == ("watch", "up", "retain", "persistent_bearish_risk,individual_bearish_risk")
    assert got[8][0] == "high" and got[9] == ("low", "up", "retain", "")
    assert got[10] == ("unavailable", "up", "retain", "") and got[11] == (None, "unavailable", "retain", "")
    assert got[12] == ("high", "neutral", "retain", "persistent_bearish_risk")
    with pytest.raises(ValueError, match="out of order"):
        decision.Policy(watch=50.0)


def test_trailing_windows(spark):
    minute = 60_000_000_000
    rows = [("s", i * minute, i, 10.0 + i, 2.0, d) for i, d in enumerate(("buy", "sell", "unknown", "buy"))] + [("t", 0, 1, 1.0, 1.0, "unknown"), ("u", S.DAY - 1, 1, 1.0, 1.0, "buy"), ("u", S.DAY + 1, 2, 2.0, 5.0, "sell")]
    df = spark.createDataFrame(rows, "symbol string, ns long, event_id long, price double, size double, direction string")
    got = {r.symbol: r for r in S.trailing(df, 2).collect()}
    assert (got["s"].trades, got["s"].open, got["s"].close, got["s"].volume, got["s"].delta, got["s"].pressure) == (3, 11.0, 13.0, 6.0, 0.0, 0.0)
    assert got["s"].coverage == pytest.approx(4 / 6) and got["t"].pressure is None and got["t"].coverage == 0.0
    assert got["u"].trades == 1 and got["u"].pressure == -100.0  # the day before has no part
    with pytest.raises(ValueError, match="minutes"):
        S.trailing(df, 391)
