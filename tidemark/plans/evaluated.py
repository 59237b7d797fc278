"""Queries over macro risk, identities and evaluation, and SQL for them that is written apart from the Spark side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluation, identity, macro, rules, state
from tidemark.operators import layers as L
from tidemark.plans import layered, relational, stateful
from tidemark.sources import bars as B

Q = relational.duck_sql

#: What the test tables' monthly order values are scaled to, by series.
LEVELS = dict(zip(macro.SERIES, (4.4, 4.2, 300.0, 75.0, 4.8, 24.0, 120.0)))


def _vintages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seven series of monthly means of order values, each released after 45 days and revised after 90; and the dates to replay."""
    orders = B.table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("observation_date"), (F.col("o_orderkey") % 7).alias("s"), "o_totalprice")
    mean = F.broadcast(orders.agg(F.avg("o_totalprice").alias("mean")))  # one row
    base = orders.groupBy("observation_date", "s").agg(F.avg("o_totalprice").alias("v")).crossJoin(mean)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("s").cast("int") + 1)
    value = pick(list(LEVELS.values())) * F.col("v") / F.col("mean")
    versions = F.explode(F.array(*(F.struct(F.lit(d).alias("days"), F.lit(f).alias("by")) for d, f in ((45, 1.0), (90, 1.01)))))
    rows = base.select(pick(list(LEVELS)).alias("series_id"), "observation_date", value.alias("value"), versions.alias("x"))
    known = F.expr("date_add(observation_date, x.days)")
    rows = rows.select("series_id", "observation_date", known.cast("timestamp").alias("available_at"), (F.col("value") * F.col("x.by")).alias("value"), known.alias("realtime_start"))
    return rows, orders.select(F.date_add("observation_date", 27).alias("asof")).distinct()


def g01_macro_risk_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of ten rules in four components, month by month, from what was known."""
    got = macro.risk(macro.values_at(*_vintages(spark, sf_dir)))
    parts = [f"{c}_{x}" for c in dict.fromkeys(r[0] for r in macro.RULES) for x in ("score", "coverage")]
    return got.select(F.col("asof").cast("string").alias("as_of"), "score", "coverage", "state", F.array_join("conditions", ",").alias("conditions"), *parts, *(F.round(v, 5).alias(v.lower()) for v in ("CURVE_10Y_2Y", *macro.CHANGES)))


def _g01_sql() -> str:
    series = ", ".join(f"({i}, '{s}', {v}::DOUBLE)" for i, (s, v) in enumerate(LEVELS.items()))
    now = lambda s: f"max(CASE WHEN series_id = '{s}' AND newest = obs THEN value END)"
    before = lambda s, d: f"arg_max(CASE WHEN series_id = '{s}' THEN value END, CASE WHEN series_id = '{s}' AND obs <= newest - {d} THEN obs END)"
    values = [f"{now(s)} AS {s}" for s in macro.SERIES] + [f"{now('DGS10')} - {now('DGS2')} AS CURVE_10Y_2Y"]
    values += [f"100 * ({now(s)} / nullif({before(s, d)}, 0) - 1) AS {n}" if percent else f"{now(s)} - {before(s, d)} AS {n}" for n, (s, d, percent) in macro.CHANGES.items()]
    components = list(dict.fromkeys(r[0] for r in macro.RULES))
    has = lambda rules: " + ".join(f"CASE WHEN {v} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for _, _, w, v, _, _ in rules)
    hit = lambda rules: " + ".join(f"CASE WHEN {v} {side} {limit} THEN {w}::DOUBLE ELSE 0 END" for _, _, w, v, limit, side in rules)
    own = {c: [r for r in macro.RULES if r[0] == c] for c in components}
    parts = ", ".join(f"round(100 * ({hit(r)}) / nullif({has(r)}, 0), 2) AS {c}_score, round(({has(r)}) / {sum(x[2] for x in r)}, 4) AS {c}_coverage" for c, r in own.items())
    names = ", ".join(f"CASE WHEN {v} {side} {limit} THEN '{n}' END" for _, n, _, v, limit, side in macro.RULES)
    return f"""
WITH ids(s, series_id, level) AS (VALUES {series}), o AS (SELECT date_trunc('month', o_orderdate)::DATE AS obs, o_orderkey % 7 AS s, o_totalprice AS p FROM orders),
b AS (SELECT obs, s, avg(p) / (SELECT avg(p) FROM o) AS v FROM o GROUP BY obs, s),
r AS (SELECT series_id, obs, level * v * f AS value, obs + d::INTEGER AS known FROM b JOIN ids USING (s), (VALUES (45, 1.0::DOUBLE), (90, 1.01::DOUBLE)) x(d, f)),
d AS (SELECT DISTINCT obs + 27 AS as_of FROM o),
n AS (SELECT as_of, series_id, obs, arg_max(value, known) AS value FROM d JOIN r ON known <= as_of GROUP BY as_of, series_id, obs),
l AS (SELECT *, max(obs) OVER (PARTITION BY as_of, series_id) AS newest FROM n),
w AS (SELECT as_of, {", ".join(values)} FROM l GROUP BY as_of), a AS (SELECT * FROM d LEFT JOIN w USING (as_of)),
z AS (SELECT *, round(({has(macro.RULES)}) / 100, 4) AS coverage, CASE WHEN ({has(macro.RULES)}) / 100 >= {macro.COVERAGE} THEN round(100 * ({hit(macro.RULES)}) / ({has(macro.RULES)}), 2) END AS score, concat_ws(',', {names}) AS conditions, {parts} FROM a)
SELECT as_of::VARCHAR AS as_of, score, coverage, CASE WHEN score IS NULL THEN 'unavailable' WHEN score >= 70 THEN 'severe' WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'watch' ELSE 'low' END AS state, conditions,
  {", ".join(f"{c}_{x}" for c in components for x in ("score", "coverage"))}, {", ".join(f"round({v}, 5) AS {v.lower()}" for v in ("CURVE_10Y_2Y", *macro.CHANGES))} FROM z"""


# Inputs of the identity ladder by rule: suppliers as delisted stocks, customers as the register, parts as a provider's hints.
_SAMPLE = "SELECT concat('S', s_suppkey) AS ticker, concat('Company ', s_suppkey % 60, ' Inc.') AS name, concat('US', s_suppkey) AS isin, CASE WHEN s_suppkey % 17 = 0 THEN 'conflicting_isin' END AS panel, date_add(DATE '1995-01-01', CAST(s_suppkey % 900 AS INT)) AS first_date, date_add(DATE '1996-01-01', CAST(s_suppkey % 900 AS INT)) AS last_date FROM $supplier"
_REGISTER = "SELECT CAST(c_custkey AS STRING) AS cik, concat('COMPANY ', c_custkey % 400, ', Inc') AS name, concat('S', c_custkey + 40) AS ticker, CASE WHEN c_custkey % 5 = 0 THEN concat('Company ', (c_custkey + 7) % 90, ' Inc') END AS old_name, DATE '1996-01-01' AS f, date_add(DATE '1996-01-01', CAST(c_custkey % 700 AS INT)) AS t FROM $customer WHERE c_custkey <= 300"
_HINTS = "SELECT concat('S', p_partkey % 200) AS ticker, CASE WHEN p_size % 3 = 0 THEN 'security_type' ELSE 'isin_cik' END AS key_type, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size = 3 THEN 'Preferred Stock' ELSE ' Common  Stock' END END AS value, CASE WHEN p_size % 3 <> 0 THEN concat('us', CASE WHEN p_size % 2 = 0 THEN p_partkey % 200 ELSE 0 END) END AS isin, CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey % 200 + CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS STRING) END AS cik FROM $part WHERE p_partkey <= 900"


def j22_identity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda text: relational.spark_sql(spark, sf_dir, text)
    sample, hints = read(_SAMPLE), read(_HINTS)
    none = F.array().cast("array<struct<name:string,from:date,to:date>>")
    former = F.when(F.col("old_name").isNotNull(), F.array(F.struct(F.col("old_name").alias("name"), F.col("f").alias("from"), F.col("t").alias("to")))).otherwise(none)
    register = read(_REGISTER).select("cik", "name", "ticker", former.alias("former"))
    return identity.adjudicate(sample, identity.name_candidates(sample, register), hints)


_PLAIN = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"
J22_SQL = Q(
    f"WITH sm AS ({_SAMPLE}), rg AS ({_REGISTER}), hi AS ({_HINTS}), "
    f"m AS (SELECT sm.ticker, rg.cik, {_PLAIN.format('sm.name')} = {_PLAIN.format('rg.name')} AS cur, coalesce({_PLAIN.format('sm.name')} = {_PLAIN.format('rg.old_name')}, FALSE) AS old, sm.ticker = upper(trim(rg.ticker)) AS sym, f, t, first_date, last_date FROM sm, rg), "
    "c AS (SELECT ticker, count(*) AS n, bool_or(cur OR old) AS named, list(CASE WHEN cur OR old THEN cik END) AS ids, max(cik) AS cik, bool_or(old AND f <= last_date AND first_date <= t) AS borne FROM m WHERE cur OR old OR sym GROUP BY ticker), "
    "e AS (SELECT sm.ticker, bool_or(key_type = 'security_type' AND lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) NOT IN ('common stock', 'common equity')) AS odd, list(DISTINCT hi.cik) FILTER (key_type = 'isin_cik' AND upper(hi.isin) = sm.isin) AS k FROM sm JOIN hi ON sm.ticker = hi.ticker GROUP BY sm.ticker), "
    "x AS (SELECT sm.ticker, panel, coalesce(odd, FALSE) AS odd, coalesce(len(k), 0) AS nk, k, coalesce(n, 0) AS n, named, ids, c.cik, borne, e.ticker IS NOT NULL AS has FROM sm LEFT JOIN c ON sm.ticker = c.ticker LEFT JOIN e ON sm.ticker = e.ticker), "
    "y AS (SELECT *, CASE WHEN odd THEN 'security_type_contradiction' WHEN panel IS NOT NULL AND nk > 0 THEN 'catalog_conflicting_isin' WHEN nk > 1 THEN 'conflicting_isin_cik' WHEN nk = 1 AND list_contains(ids, k[1]) THEN 'isin_cik_plus_exact_name' WHEN n = 1 AND borne THEN 'dated_former_name_overlap' WHEN n > 1 THEN 'competing_ciks' WHEN n = 1 AND NOT named THEN 'ticker_only_match' WHEN n = 1 THEN 'undated_exact_name' WHEN NOT has THEN 'no_identity_candidates' ELSE 'provider_evidence_only' END AS rule FROM x) "
    "SELECT ticker, CASE rule WHEN 'isin_cik_plus_exact_name' THEN k[1] WHEN 'dated_former_name_overlap' THEN cik END AS cik, CASE WHEN rule = 'security_type_contradiction' THEN 'rejected' WHEN rule IN ('isin_cik_plus_exact_name', 'dated_former_name_overlap') THEN 'confirmed' WHEN rule = 'no_identity_candidates' THEN 'unresolved' ELSE 'review_required' END AS status, rule FROM y"
)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a fall by two specifications, for each group, year and all or non-overlapping samples."""
    f = L.stack(layered.base(spark, sf_dir, "week", True), relational.FEATURES).join(B.groups(spark, sf_dir), "ticker")
    both = F.explode(F.array(F.struct(F.lit("volume").alias("specification"), F.col("vr").alias("score")), F.struct(F.lit("close").alias("specification"), (-F.col("cl")).alias("score")))).alias("x")
    rows = f.select(F.col("grp").alias("scope"), F.year("session").cast("long").alias("fold"), "pos", both, "mature", F.col("tail_down").alias("actual_event"), F.least("fwd", F.lit(1.0)).alias("terminal_return"), "mae", F.least("mfe", F.lit(1.0)).alias("mfe"))
    modes = F.explode(F.when(F.col("pos") % 5 == 0, F.array(F.lit("all"), F.lit("non_overlapping"))).otherwise(F.array(F.lit("all")))).alias("sample_mode")
    limit = F.when(F.col("x.specification") == "volume", 1.2).otherwise(0.2)
    return rows.select(
        "scope", "fold", modes, "x.specification", "mature", "actual_event", "terminal_return", "mae", "mfe", F.round("x.score", 9).alias("predicted_score"), (F.col("x.score") >= limit).alias("predicted_event"),
        F.when(F.col("x.score").isNull(), "unavailable").otherwise("available").alias("status"), F.lit(None).cast("double").alias("lead_sessions"),
    )


KEYS = ["scope", "fold", "sample_mode", "specification"]


def m12_evaluation_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation.metric_rows(_predictions(spark, sf_dir), KEYS, 30)
    whole = ("sample_count", "excluded_unavailable_count", "excluded_immature_count", "signal_count")
    return got.select(*KEYS, *whole, "status", *(F.round(c, 6).alias(c) for c in got.columns if c not in (*KEYS, *whole, "status", "mean_lead_sessions")))


_PRED_SQL = (
    "WITH f AS (SELECT $features.*, g.grp FROM $features JOIN $groups g USING (ticker)), "
    "s AS (SELECT grp AS scope, year(session) AS fold, pos, 'volume' AS specification, vr AS score, vr >= 1.2D AS hit, mature, tail_down AS y, least(fwd, 1) AS fwd, mae, least(mfe, 1) AS mfe FROM f UNION ALL SELECT grp, year(session), pos, 'close', -cl, -cl >= 0.2D, mature, tail_down, least(fwd, 1), mae, least(mfe, 1) FROM f), "
    "r AS (SELECT s.*, m.sample_mode, s.score IS NOT NULL AND s.mature AS ok, round(score, 9) AS sc FROM s JOIN (SELECT 'all' AS sample_mode UNION ALL SELECT 'non_overlapping') m ON m.sample_mode = 'all' OR s.pos % 5 = 0), "
    "t AS (SELECT scope, fold, sample_mode, specification, sc, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r WHERE ok GROUP BY ALL), "
    "u AS (SELECT a.scope, a.fold, a.sample_mode, a.specification, count(DISTINCT a.sc) AS scores, sum(a.p * b.q * CASE WHEN a.sc > b.sc THEN 1D WHEN a.sc = b.sc THEN 0.5D ELSE 0D END) AS wins FROM t a JOIN t b USING (scope, fold, sample_mode, specification) GROUP BY ALL), "
    "c AS (SELECT a.scope, a.fold, a.sample_mode, a.specification, a.sc, any_value(a.p) AS p, sum(b.p) AS tp, sum(b.q) AS fp FROM t a JOIN t b ON a.scope = b.scope AND a.fold = b.fold AND a.sample_mode = b.sample_mode AND a.specification = b.specification AND b.sc >= a.sc GROUP BY a.scope, a.fold, a.sample_mode, a.specification, a.sc), "
    "v AS (SELECT scope, fold, sample_mode, specification, sum(p * tp / (tp + fp)) AS ap FROM c GROUP BY ALL), "
    "b AS (SELECT scope, fold, sample_mode, specification, count(*) FILTER (ok) AS n, count(*) FILTER (score IS NULL) AS no_score, count(*) FILTER (NOT mature) AS young, CAST(count(*) FILTER (ok AND hit AND y) AS DOUBLE) AS tp, CAST(count(*) FILTER (ok AND hit AND NOT y) AS DOUBLE) AS fp, CAST(count(*) FILTER (ok AND NOT hit AND y) AS DOUBLE) AS fn, CAST(count(*) FILTER (ok AND NOT hit AND NOT y) AS DOUBLE) AS tn, "
    "avg(fwd) FILTER (ok) AS mf, avg(mae) FILTER (ok) AS ma, avg(mfe) FILTER (ok) AS mx, avg(mfe) FILTER (ok AND hit AND NOT y) AS cost FROM r GROUP BY ALL), "
    "d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(tn / nullif(tn + fp, 0), 0) AS sp, coalesce(tn / nullif(tn + fn, 0), 0) AS np, n >= 30 AND tp + fn > 0 AND fp + tn > 0 AS good FROM b LEFT JOIN u USING (scope, fold, sample_mode, specification) LEFT JOIN v USING (scope, fold, sample_mode, specification)), "
)
M12_SQL = Q(
    _PRED_SQL.rstrip(", ")
    + " SELECT scope, fold, sample_mode, specification, n AS sample_count, no_score AS excluded_unavailable_count, young AS excluded_immature_count, CASE WHEN good THEN CAST(tp + fp AS BIGINT) ELSE 0 END AS signal_count, CASE WHEN good THEN 'ok' ELSE 'insufficient' END AS status, "
    + ", ".join(
        f"CASE WHEN good THEN round({x}, 6) END AS {n}"
        for n, x in {
            "event_rate": "(tp + fn) / n", "signal_rate": "(tp + fp) / n", "precision": "pr", "recall": "re", "specificity": "sp", "balanced_accuracy": "(re + sp) / 2",
            "macro_f1": "(coalesce(2 * pr * re / nullif(pr + re, 0), 0) + coalesce(2 * np * sp / nullif(np + sp, 0), 0)) / 2", "false_positive_rate": "1 - sp",
            "roc_auc": "CASE WHEN scores > 2 THEN wins / ((tp + fn) * (fp + tn)) END", "pr_auc": "CASE WHEN scores > 2 THEN ap / (tp + fn) END", "mean_terminal_return": "mf", "mean_mae": "ma", "mean_mfe": "mx", "false_positive_opportunity_cost": "cost",
        }.items()
    )
    + " FROM d"
)


def m13_promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluation.metric_rows(_predictions(spark, sf_dir), KEYS, 30)
    compared = evaluation.compare_folds(metrics, ["scope", "sample_mode"], "volume")
    gate = evaluation.promotion_gate(metrics, compared, ["1", "2"], "volume").select(F.col("passed"), F.array_join("reasons", ",").alias("reasons"))
    return compared.select("scope", "sample_mode", "specification", "comparable_fold_count", F.round("fold_win_rate", 6).alias("fold_win_rate"), F.round("mean_difference", 6).alias("mean_difference")).crossJoin(F.broadcast(gate))  # one row


M13_SQL = Q(
    _PRED_SQL
    + "k AS (SELECT scope, sample_mode, fold, specification, (re + sp) / 2 AS m FROM d WHERE good), "
    "w AS (SELECT a.scope, a.sample_mode, a.specification, count(*) AS comparable_fold_count, avg(CASE WHEN a.m > b.m THEN 1D ELSE 0D END) AS rate, avg(a.m - b.m) AS diff FROM k a JOIN k b ON a.scope = b.scope AND a.sample_mode = b.sample_mode AND a.fold = b.fold AND b.specification = 'volume' WHERE a.specification <> 'volume' GROUP BY ALL), "
    "z AS (SELECT (SELECT count(DISTINCT scope) FROM k WHERE sample_mode = 'non_overlapping' AND scope IN ('1', '2')) < 2 AS lacks, (SELECT count(*) FROM w) AS n, (SELECT count(*) FROM w WHERE sample_mode = 'non_overlapping' AND comparable_fold_count >= 3 AND rate > 0.5) AS won) "
    "SELECT scope, sample_mode, specification, comparable_fold_count, round(rate, 6) AS fold_win_rate, round(diff, 6) AS mean_difference, NOT lacks AND n > 0 AND won > 0 AS passed, concat_ws(',', CASE WHEN lacks THEN 'required_group_evidence_missing' END, CASE WHEN n = 0 THEN 'paired_fold_evidence_missing' WHEN won = 0 THEN 'fold_majority_not_won' END) AS reasons FROM w, z"
)

GROUPS = {"pressure": ["vr", "cl"], "trend": ["chg_20", "off_high"], "relative": ["rel_5"]}


def m15_leave_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a score by points, with all evidence and without each group of it."""
    f = L.stack(layered.base(spark, sf_dir, "week", True), relational.FEATURES).select("tail_down", "mature", *(c for g in GROUPS.values() for c in g))
    limits = {"vr": (">=", 1.2), "cl": ("<=", -0.2), "chg_20": ("<=", -0.05), "off_high": ("<=", -0.3), "rel_5": ("<=", -0.02)}
    point = lambda c, x: F.when(x >= limits[c][1] if limits[c][0] == ">=" else x <= limits[c][1], 1.0).otherwise(0.0)
    rows = evaluation.ablations(f, GROUPS, lambda v: sum((point(c, v[c]) for c in limits), F.lit(0.0)))
    rows = rows.select("specification", F.lit("available").alias("status"), "mature", F.col("tail_down").alias("actual_event"), F.col("score").alias("predicted_score"), (F.col("score") >= 3).alias("predicted_event"), *(F.lit(0.0).alias(c) for c in ("terminal_return", "mae", "mfe", "lead_sessions")))
    got = evaluation.metric_rows(rows, ["specification"], 30)
    return got.select("specification", "sample_count", "signal_count", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "roc_auc")))


def _m15_sql() -> str:
    point = {"vr": "vr >= 1.2", "cl": "cl <= -0.2", "chg_20": "chg_20 <= -0.05", "off_high": "off_high <= -0.3", "rel_5": "rel_5 <= -0.02"}
    total = lambda cs: " + ".join(f"CASE WHEN {point[c]} THEN 1 ELSE 0 END" for c in cs)
    specs = {"all": list(point), **{f"without_{g}": [c for c in point if c not in cs] for g, cs in GROUPS.items()}}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS specification, {total(cs)} AS s, tail_down AS y FROM $features WHERE mature" for n, cs in specs.items())
    return Q(
        f"WITH r AS ({rows}), k AS (SELECT specification, y, s, rank() OVER (PARTITION BY specification ORDER BY s) + (count(*) OVER (PARTITION BY specification, s) - 1) / 2D AS k FROM r) "
        "SELECT specification, count(*) AS sample_count, count(*) FILTER (s >= 3) AS signal_count, round(coalesce(CAST(count(*) FILTER (s >= 3 AND y) AS DOUBLE) / nullif(count(*) FILTER (s >= 3), 0), 0), 6) AS precision, round(CAST(count(*) FILTER (s >= 3 AND y) AS DOUBLE) / count(*) FILTER (y), 6) AS recall, "
        "CASE WHEN count(DISTINCT s) > 2 THEN round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2D) / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)), 6) END AS roc_auc FROM k GROUP BY specification"
    )


M15_SQL = _m15_sql()


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls against the same ticker's session five before, by group."""
    f = L.stack(layered.base(spark, sf_dir, "week", True), relational.FEATURES).join(B.groups(spark, sf_dir), "ticker")
    w = Window.partitionBy("ticker").orderBy("session")
    rows = f.select("grp", "session", F.col("pos"), "tail_down", *(F.col(c).alias(f"case_{c}") for c in ("vr", "cl", "chg_20")), *(F.lag(c, 5).over(w).alias(f"control_{c}") for c in ("vr", "cl", "chg_20")))
    return rows.where("tail_down AND pos > 5")


def m16_paired_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation.paired_evidence(_evidence(spark, sf_dir), ["vr", "cl", "chg_20"], ["grp"], resamples=1)
    return got.select("grp", "feature", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("standardised", 5).alias("standardised"))


M16_SQL = Q(
    "WITH f AS (SELECT $features.*, g.grp FROM $features JOIN $groups g USING (ticker)), p AS (SELECT grp, pos, tail_down, vr, cl, chg_20, lag(vr, 5) OVER w AS a, lag(cl, 5) OVER w AS b, lag(chg_20, 5) OVER w AS c FROM f WINDOW w AS (PARTITION BY ticker ORDER BY session)), "
    "d AS (SELECT grp, 'vr' AS feature, vr - a AS d FROM p WHERE tail_down AND pos > 5 UNION ALL SELECT grp, 'cl', cl - b FROM p WHERE tail_down AND pos > 5 UNION ALL SELECT grp, 'chg_20', chg_20 - c FROM p WHERE tail_down AND pos > 5) "
    "SELECT grp, feature, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg(d) / nullif(stddev_samp(d), 0), 5) AS standardised FROM d WHERE d IS NOT NULL GROUP BY grp, feature"
)


def m16b_paired_evidence_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 2,000 resamples of 20-day blocks, false-discovery rates and admission; hashed draws, so without SQL."""
    got = evaluation.paired_evidence(_evidence(spark, sf_dir), ["vr", "cl", "chg_20"], ["grp"])
    return got.select("grp", "feature", "n", *(F.round(c, 6).alias(c) for c in ("mean", "standardised", "low", "high", "p", "q")), "admitted")


def p22_technical_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.stack(state.with_emas(B.bars(spark, sf_dir), (10, 20)), rules.TECHNICAL_GATE)
    return rows.select("ticker", F.col("session").cast("string").alias("session"), "technical_gate", F.col("passed_conditions").cast("long").alias("passed_conditions"), "preferred_within_15pct")


P22_SQL = Q(
    "WITH h AS (SELECT b.*, e.ema10, e.ema20, list(b.close) OVER w AS c, list(e.ema10) OVER w AS x, list(e.ema20) OVER w AS y FROM $bars b JOIN $emas e ON b.ticker = e.ticker AND b.session = e.session WINDOW w AS (PARTITION BY b.ticker ORDER BY b.session ROWS UNBOUNDED PRECEDING)), "
    "k AS (SELECT *, len(c) AS n, list_avg(c[-50:]) AS m, list_max(c[-252:]) AS top FROM h), "
    "g AS (SELECT ticker, session, [CASE WHEN n < 50 THEN 'missing' WHEN close > m THEN 'pass' ELSE 'fail' END, CASE WHEN n < 20 THEN 'missing' WHEN ema10 > ema20 THEN 'pass' ELSE 'fail' END, CASE WHEN n < 25 THEN 'missing' WHEN ema10 > x[n - 5] AND ema20 > y[n - 5] THEN 'pass' ELSE 'fail' END, CASE WHEN n < 252 THEN 'missing' WHEN close / top - 1 >= -0.2D THEN 'pass' ELSE 'fail' END] AS s, n >= 252 AND close / top - 1 >= -0.15D AS near FROM k) "
    "SELECT ticker, CAST(session AS STRING) AS session, CASE WHEN list_contains(s, 'fail') THEN 'fail' WHEN list_contains(s, 'missing') THEN 'missing' ELSE 'pass' END AS technical_gate, len(list_filter(s, lambda z: z = 'pass')) AS passed_conditions, near AS preferred_within_15pct FROM g"
)


def p23_market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's regime by session: the pooled index leads, the first group's bars are the second index."""
    market = B.index_bars(spark, sf_dir).select(F.lit("market").alias("ticker"), "session", *(F.col(f"m_{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))
    second = B.group_bars(spark, sf_dir).where("ticker = 'Brand#11'").select("session", F.col("g_close").alias("s_close"))
    rows = L.stack(state.with_emas(market.join(second, "session"), (20,)), rules.REGIME)
    return rows.select(F.col("session").cast("string").alias("session"), "regime", F.round("r_5", 6).alias("return_5"), F.round("r_20", 6).alias("return_20"), F.col("r_days").cast("double").alias("distribution_days_20"), F.col("pressure_conditions").cast("long").alias("pressure_conditions"))


P23_SQL = (
    f"WITH m AS (SELECT i.session, m_high AS h, m_low AS l, m_close AS c, m_volume AS v, g_close AS s FROM ({B.index_bars_sql()}) i JOIN ({B.group_bars_sql()}) g ON g.session = i.session AND g.ticker = 'Brand#11'), "
    "a AS (SELECT *, lag(c) OVER o AS b, list(c) OVER p AS cs, list(s) OVER p AS ss, list(v) OVER p AS vs, count(*) OVER p AS n FROM m WINDOW o AS (ORDER BY session), p AS (ORDER BY session ROWS UNBOUNDED PRECEDING)), "
    f"d AS (SELECT *, list_reduce(cs, lambda e, x: e + (x - e) * {2 / 21!r}::DOUBLE) AS ema, greatest(h - l, coalesce(abs(h - b), 0), coalesce(abs(l - b), 0)) AS tr, CASE WHEN n > 20 THEN CASE WHEN c < b AND v > list_avg(vs[-21:-2]) THEN 1 ELSE 0 END END AS day FROM a), "
    "e AS (SELECT *, list(tr) OVER p AS ts, sum(day) OVER (ORDER BY session ROWS 19 PRECEDING) AS days, count(day) OVER (ORDER BY session ROWS 19 PRECEDING) AS nd, c / nullif(cs[n - 5], 0) - 1 AS r5, c / nullif(cs[n - 20], 0) - 1 AS r20 FROM d WINDOW p AS (ORDER BY session ROWS UNBOUNDED PRECEDING)), "
    "f AS (SELECT *, CASE WHEN n >= 6 THEN r5 END AS q5, CASE WHEN n >= 21 THEN r20 END AS q20, CASE WHEN nd = 20 THEN days END AS qd, list_avg(cs[-50:]) AS m50, list_avg(cs[-200:]) AS m200, list_avg(ss[-50:]) AS s50, list_max(cs[-64:-2]) AS top, list_avg(ts[-20:]) / c AS atr FROM e), "
    "g AS (SELECT *, CASE WHEN c < ema THEN 1 ELSE 0 END + CASE WHEN n >= 50 AND s < s50 THEN 1 ELSE 0 END + CASE WHEN q20 < 0 THEN 1 ELSE 0 END + CASE WHEN qd >= 4 THEN 1 ELSE 0 END AS k FROM f) "
    "SELECT session::VARCHAR AS session, CASE WHEN n < 200 THEN 'unavailable' WHEN r5 <= -0.07 OR (r20 <= -0.12 AND atr >= 0.025) THEN 'acute_selloff' WHEN c < m50 AND (r20 <= -0.05 OR c / top - 1 <= -0.08) THEN 'correction' WHEN k >= 2 THEN 'under_pressure' WHEN c > ema AND c > m50 AND c > m200 THEN 'uptrend' ELSE 'range_bound' END AS regime, "
    "round(q5, 6) AS return_5, round(q20, 6) AS return_20, qd::DOUBLE AS distribution_days_20, k::BIGINT AS pressure_conditions FROM g"
)


def p18_rule_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction, probability, move and confidence from a total of four trend points of 25."""
    f = L.stack(layered.base(spark, sf_dir, "week", True), relational.FEATURES).where("sma50 IS NOT NULL")
    total = "CASE WHEN close > sma20 THEN 25D ELSE 0D END + CASE WHEN sma20 > sma50 THEN 25D ELSE 0D END + CASE WHEN rel_20 > 0 THEN 25D ELSE 0D END + CASE WHEN vr > 1 AND ret > 0 THEN 25D WHEN ret > 0 THEN 15D ELSE 0D END"
    rows = f.selectExpr("ticker", "session", f"{total} AS total", "m_chg_20 > 0 AS market_ok", "over_pivot", "vr AS volume_ratio", "pivot_breakout AS breakout", "adr_20", "mom_252 AS rs", "dollar_volume_20 IS NULL AS gaps")
    shown = ("direction", "vetoes", "confidence")
    return L.stack(rows, rules.PREDICTION).select("ticker", F.col("session").cast("string").alias("session"), *shown, F.round("up_probability", 3).alias("up_probability"), "expected_move")


P18_SQL = Q(
    "WITH t AS (SELECT *, CASE WHEN close > sma20 THEN 25 ELSE 0 END + CASE WHEN sma20 > sma50 THEN 25 ELSE 0 END + CASE WHEN rel_20 > 0 THEN 25 ELSE 0 END + CASE WHEN ret > 0 THEN CASE WHEN vr > 1 THEN 25 ELSE 15 END ELSE 0 END AS p, coalesce(m_chg_20 > 0, false) AS ok, coalesce(over_pivot > 5, false) AS far, coalesce(vr > 0 AND vr < 1 AND pivot_breakout, false) AS thin FROM $features WHERE sma50 IS NOT NULL), "
    "d AS (SELECT *, CASE WHEN p >= 80 THEN CASE WHEN ok AND NOT thin THEN 2 ELSE 1 END WHEN p >= 70 THEN 1 WHEN p >= 55 THEN 0 WHEN p >= 45 THEN -1 ELSE -2 END AS k, CASE WHEN p >= 90 THEN 0.74D WHEN p >= 80 THEN 0.66D WHEN p >= 70 THEN 0.585D WHEN p >= 55 THEN 0.5D WHEN p >= 45 THEN 0.42D ELSE 0.35D END AS q, (NOT ok OR far OR thin OR mom_252 IS NULL) AS doubt FROM t) "
    "SELECT ticker, CAST(session AS STRING) AS session, ['down', 'weak_down', 'sideways', 'weak_up', 'up'][k + 3] AS direction, array_to_string(list_filter([CASE WHEN NOT ok THEN 'market_not_confirmed' END, CASE WHEN far THEN 'beyond_pivot' END, CASE WHEN thin THEN 'breakout_on_low_volume' END], lambda z: z IS NOT NULL), ',') AS vetoes, "
    "CASE (CASE WHEN doubt THEN 1 ELSE 0 END + CASE WHEN dollar_volume_20 IS NULL THEN 1 ELSE 0 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, round(least(q, CASE WHEN ok THEN 1D ELSE 0.55D END, CASE WHEN far THEN 0.5D ELSE 1D END), 3) AS up_probability, round(coalesce(nullif(adr_20, 0), 3D) * 1.5D * k, 1) AS expected_move FROM d"
)


def x17_transition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a ticker's bottom state, and what came of it in 5, 10 and 20 sessions."""
    states = stateful.x14_bottom_state(spark, sf_dir).select("ticker", F.to_date("session").alias("session"), "state")
    got = evaluation.transition_outcomes(B.bars(spark, sf_dir).join(states, ["ticker", "session"]), (5, 10, 20))
    return got.select("ticker", F.col("session").cast("string").alias("session"), "was", "state", *(F.round(c, 6).alias(c) for c in got.columns[4:]))


QUERIES = {
    "p18_rule_prediction": p18_rule_prediction,
    "p22_technical_gate": p22_technical_gate,
    "p23_market_regime": p23_market_regime,
    "x17_transition_outcomes": x17_transition_outcomes,
    "g01_macro_risk_replay": g01_macro_risk_replay,
    "j22_identity_ladder": j22_identity_ladder,
    "m12_evaluation_contract": m12_evaluation_contract,
    "m13_promotion_gates": m13_promotion_gates,
    "m15_leave_group_out": m15_leave_group_out,
    "m16_paired_evidence": m16_paired_evidence,
    "m16b_paired_evidence_tested": m16b_paired_evidence_tested,
}
ORACLE_SQL = {
    "p18_rule_prediction": P18_SQL,
    "p22_technical_gate": P22_SQL,
    "p23_market_regime": P23_SQL,
    "g01_macro_risk_replay": _g01_sql(),
    "j22_identity_ladder": J22_SQL,
    "m12_evaluation_contract": M12_SQL,
    "m13_promotion_gates": M13_SQL,
    "m15_leave_group_out": M15_SQL,
    "m16_paired_evidence": M16_SQL,
}
