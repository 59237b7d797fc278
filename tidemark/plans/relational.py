"""Joins, aggregations and set operations over bars and the star-schema tables.

Queries whose text both engines read alike are kept as one text; `$name` stands for a table that the
library builds as a DataFrame. The plans are Catalyst's: hash aggregates with partial sums, equi-joins, and
windows that sort each ticker once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import layers as L
from tidemark.operators import state
from tidemark.plans import layered
from tidemark.sources import bars as B

FEATURES = [*L.PRESSURE, *L.COUNTS, *L.TREND, *L.SIGNALS, *L.RELATIVE, *L.labels(5)]
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "nation", "region")

#: Half-open memberships [from, to) by rule: each ticker joins 10 days after the one before; every third leaves, and returns a year later.
MEMBERS = """
SELECT ticker, 'core' AS universe, date_add(DATE '1995-06-01', k * 10) AS effective_from, CASE WHEN k % 3 = 0 THEN date_add(DATE '1997-06-01', k * 10) END AS effective_to, 1 AS version FROM (SELECT ticker, CAST(substring(ticker, 7) AS INT) AS k FROM $groups) t
UNION ALL SELECT ticker, 'core', date_add(DATE '1998-06-01', k * 10), NULL, 2 FROM (SELECT ticker, CAST(substring(ticker, 7) AS INT) AS k FROM $groups) t WHERE k % 3 = 0"""


def _frames(spark: SparkSession, sf_dir: str, names: set[str]) -> dict[str, DataFrame]:
    made: dict[str, Callable[[], DataFrame]] = {
        "bars": lambda: B.bars(spark, sf_dir),
        "days": lambda: B.bars(spark, sf_dir, "day"),
        "market": lambda: B.index_bars(spark, sf_dir),
        "groups": lambda: B.groups(spark, sf_dir),
        "features": lambda: L.stack(layered.base(spark, sf_dir, "week", True), FEATURES),
        "trades": lambda: B.market_events(spark, sf_dir),
        "emas": lambda: state.emas(B.bars(spark, sf_dir)),
        "strong": lambda: L.stack(B.bars(spark, sf_dir), L.STRENGTH),
        "members": lambda: spark_sql(spark, sf_dir, MEMBERS),
    }
    return {n: made[n]() if n in made else B.table(spark, sf_dir, n) for n in names}


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = set(re.findall(r"\$(\w+)", text))
    return spark.sql(re.sub(r"\$(\w+)", r"{\1}", text), **_frames(spark, sf_dir, names))


def _calls(text: str, name: str, write: Callable[[str, str], str]) -> str:
    """Rewrites two-argument calls of a function whose arguments may hold calls themselves."""
    while (at := text.find(name + "(")) >= 0:
        depth, start, args = 0, at + len(name) + 1, []
        for i in range(start, len(text)):
            if text[i] == "(":
                depth += 1
            elif text[i] == ")" and depth:
                depth -= 1
            elif text[i] == "," and not depth:
                args.append(text[start:i].strip())
                start = i + 1
            elif text[i] == ")":
                args.append(text[start:i].strip())
                break
        text = text[:at] + write(*args) + text[i + 1 :]
    return text


def duck_sql(text: str) -> str:
    text = text.replace("$members", f"({MEMBERS})")
    names = set(re.findall(r"\$(\w+)", text))
    built = {"bars": B.bars_sql(), "days": B.bars_sql("day"), "market": B.index_bars_sql(), "groups": B.GROUPS_SQL, "trades": B.MARKET_EVENTS_SQL}
    ctes = [f"{n} AS ({built[n]})" for n in sorted(names & set(built))]
    if "emas" in names:
        ctes.append(f"emas AS ({B.emas_sql()})")
    if "strong" in names:
        ctes.append("strong AS (WITH " + layered.stack_sql(L.STRENGTH) + " SELECT * FROM top)")
    if "features" in names:
        ctes.append(layered.stack_sql(FEATURES, "week", True) + ", features AS (SELECT * FROM top)")
    text = re.sub(r"\$(\w+)", r"\1", text)
    text = _calls(text, "date_add", lambda d, n: f"CAST({d} + CAST({n} AS INTEGER) AS DATE)")
    text = layered.plain(_calls(text, "datediff", lambda a, b: f"date_diff('day', {b}, {a})"))
    if not ctes:
        return text
    rest = re.sub(r"^\s*WITH ", ", ", text)
    return f"WITH {', '.join(ctes)} {rest}"


def _numbers(first: int, last: int) -> str:
    """A constant table of one column n."""
    return " UNION ALL ".join(f"SELECT {i} AS n" for i in range(first, last + 1))


def _near(days: int) -> tuple[str, str, str]:
    """Band joins by date as equi-joins: a bucket of each event, the three around each control, and the exact test."""
    bucket = lambda a: f"CAST(floor(datediff({a}.session, DATE '1970-01-01') / {days + 1}) AS BIGINT)"
    return bucket("e"), f"(SELECT c.*, {bucket('c')} + k.n AS near FROM c JOIN ({_numbers(-1, 1)}) k ON k.n IS NOT NULL)", f"abs(datediff(c.session, e.session)) <= {days}"


NEAR_60, NEAR_63, NEAR_120 = _near(60), _near(63), _near(120)

TEXTS: dict[str, str] = {
    "j01_calendar_intersection": "SELECT CAST(b.session AS STRING) AS session, count(*) AS n FROM $bars b JOIN $market m ON b.session = m.session GROUP BY b.session",
    "j05_interval_join": "SELECT b.ticker, CAST(b.session AS STRING) AS session, CAST(m.version AS DOUBLE) AS version FROM $bars b LEFT JOIN $members m ON b.ticker = m.ticker AND m.effective_from <= b.session AND (m.effective_to IS NULL OR b.session < m.effective_to)",
    "j06_membership_semi_join": "SELECT b.ticker, CAST(b.session AS STRING) AS session FROM $bars b WHERE EXISTS (SELECT 1 FROM $members m WHERE m.ticker = b.ticker AND m.effective_from <= b.session AND (m.effective_to IS NULL OR b.session < m.effective_to))",
    "j07_left_metadata": "SELECT c.c_custkey, c.c_mktsegment, n.n_name, r.r_name FROM $customer c LEFT JOIN $nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN $region r ON n.n_regionkey = r.r_regionkey",
    "j08_lag_to_newest": "SELECT t.ticker, CAST(t.last AS STRING) AS last, CAST(datediff(g.newest, t.last) AS BIGINT) AS lag_days FROM (SELECT ticker, max(session) AS last FROM $days GROUP BY ticker) t CROSS JOIN (SELECT max(session) AS newest FROM $days) g",
    "j09_anti_join": "SELECT b.ticker, CAST(b.session AS STRING) AS session FROM $bars b WHERE NOT EXISTS (SELECT 1 FROM $members m WHERE m.ticker = b.ticker AND m.effective_from <= b.session)",
    "j10_one_to_one_check": "SELECT ticker, CAST(session AS STRING) AS session, count(*) AS n FROM $bars GROUP BY ticker, session HAVING count(*) > 1",
    "j11_paired_with_baseline": "SELECT a.ticker, a.y AS year, round(a.m - b.m, 6) AS excess FROM (SELECT ticker, year(session) AS y, avg(ret) AS m FROM $features WHERE ret < 5 GROUP BY ticker, year(session)) a JOIN (SELECT year(session) AS y, avg(m_chg_5) AS m FROM $features GROUP BY year(session)) b ON a.y = b.y",
    "j12_nearest_control": "WITH e AS (SELECT ticker, session, off_high FROM $features WHERE pocket_pivot AND off_high IS NOT NULL), c AS (SELECT ticker, session, off_high FROM $features WHERE NOT pocket_pivot AND off_high IS NOT NULL), "
    "p AS (SELECT e.ticker, e.session, c.session AS control, row_number() OVER (PARTITION BY e.ticker, e.session ORDER BY round(abs(e.off_high - c.off_high), 9), abs(datediff(c.session, e.session)), c.session) AS k FROM (SELECT e.*, " + NEAR_60[0] + " AS near FROM e) e JOIN " + NEAR_60[1] + " c ON e.ticker = c.ticker AND e.near = c.near AND " + NEAR_60[2] + ") "
    "SELECT ticker, CAST(session AS STRING) AS session, CAST(control AS STRING) AS control FROM p WHERE k = 1",
    "j13_sampled_controls": "WITH e AS (SELECT ticker, session FROM $features WHERE pivot_breakout), c AS (SELECT ticker, session FROM $features WHERE NOT pivot_breakout), "
    "p AS (SELECT e.ticker, e.session, c.session AS control, row_number() OVER (PARTITION BY e.ticker, e.session ORDER BY md5(concat(e.ticker, '|', CAST(e.session AS STRING), '|', CAST(c.session AS STRING)))) AS k FROM (SELECT e.*, " + NEAR_120[0] + " AS near FROM e) e JOIN " + NEAR_120[1] + " c ON e.ticker = c.ticker AND e.near = c.near AND " + NEAR_120[2] + ") "
    "SELECT ticker, CAST(session AS STRING) AS session, CAST(control AS STRING) AS control, k FROM p WHERE k <= 5",
    "j19_group_members": "SELECT g.grp, b.ticker, count(*) AS n FROM $groups g JOIN $bars b ON g.ticker = b.ticker GROUP BY g.grp, b.ticker",
    "j20_metrics_inside_membership": "WITH x AS (SELECT b.ticker, b.session, b.close, m.version FROM $bars b JOIN $members m ON b.ticker = m.ticker AND m.effective_from <= b.session AND (m.effective_to IS NULL OR b.session < m.effective_to)) "
    "SELECT ticker, CAST(session AS STRING) AS session, version, round(CASE WHEN count(close) OVER (PARTITION BY ticker, version ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN avg(close) OVER (PARTITION BY ticker, version ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 5) AS sma10 FROM x",
    "j21_period_matrix": "WITH p AS (SELECT 1 AS id, DATE '1995-06-01' AS a, DATE '1996-06-01' AS z UNION ALL SELECT 2, DATE '1997-01-01', DATE '1999-01-01' UNION ALL SELECT 3, DATE '2000-01-01', NULL), t AS (SELECT ticker, min(session) AS first, max(session) AS last FROM $bars GROUP BY ticker), "
    "x AS (SELECT p.id, p.a, p.z, t.ticker, t.first, count(b.session) AS n FROM p CROSS JOIN t LEFT JOIN $bars b ON b.ticker = t.ticker AND b.session >= p.a AND (p.z IS NULL OR b.session < p.z) GROUP BY p.id, p.a, p.z, t.ticker, t.first) "
    "SELECT id, ticker, n, CASE WHEN first > a THEN 'not_listed' WHEN n < 20 THEN 'insufficient_history' WHEN z IS NULL THEN 'incomplete' ELSE 'complete' END AS status FROM x",
    "a01_coverage": "SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, CAST(min(session) AS STRING) AS first, CAST(max(session) AS STRING) AS last FROM $days",
    "a02_freshness": "SELECT CAST(last AS STRING) AS last, count(*) AS tickers FROM (SELECT ticker, max(session) AS last FROM $days GROUP BY ticker) t GROUP BY last",
    "a03_history_years": "SELECT ticker, count(*) AS n, round(datediff(max(session), min(session)) / 365.2425D, 6) AS years, count(*) >= 252 AS enough FROM $days GROUP BY ticker",
    "a04_distinct_per_sector": "SELECT n.n_name, count(DISTINCT s.s_suppkey) AS suppliers FROM $supplier s JOIN $nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey IN (SELECT l_suppkey FROM $lineitem WHERE l_quantity > 10) GROUP BY n.n_name",
    "a05_a06_breadth": "SELECT CAST(session AS STRING) AS session, round(avg(CASE WHEN sma20 IS NOT NULL THEN CASE WHEN close > sma20 THEN 1D ELSE 0D END END), 6) AS above_20, round(avg(CASE WHEN sma50 IS NOT NULL THEN CASE WHEN close > sma50 THEN 1D ELSE 0D END END), 6) AS above_50, count(CASE WHEN sma20 IS NOT NULL AND sma50 IS NOT NULL THEN 1 END) AS n FROM $features GROUP BY session",
    "a07_composite_index": "SELECT CAST(session AS STRING) AS session, round(sum(ln(1 + r)) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING), 5) AS log_level FROM (SELECT session, coalesce(avg(least(coalesce(ret, 0), 0.5D)), 0) AS r FROM $features GROUP BY session) t",
    "a08_high_low_balance": "SELECT CAST(session AS STRING) AS session, round(avg(CASE WHEN high >= high_252 THEN 1D WHEN low <= low_252 THEN -1D ELSE 0D END), 6) AS balance FROM $features WHERE high_252 IS NOT NULL GROUP BY session",
    "a09_confusion_metrics": "SELECT round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall_, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM "
    "(SELECT sum(CASE WHEN p AND y THEN 1D ELSE 0D END) AS tp, sum(CASE WHEN p AND NOT y THEN 1D ELSE 0D END) AS fp, sum(CASE WHEN NOT p AND y THEN 1D ELSE 0D END) AS fn, sum(CASE WHEN NOT p AND NOT y THEN 1D ELSE 0D END) AS tn FROM (SELECT distribution AS p, tail_down AS y FROM $features WHERE tail_down IS NOT NULL) t) u",
    "a10_metrics_cube": "SELECT coalesce(grp, 'all') AS grp, coalesce(CAST(y AS STRING), 'all') AS year, n, round(hit, 6) AS hit, CASE WHEN n < 50 THEN 'insufficient' ELSE 'ok' END AS status FROM (SELECT g.grp, year(f.session) AS y, count(*) AS n, avg(CASE WHEN f.tail_down THEN 1D ELSE 0D END) AS hit FROM $features f JOIN $groups g ON f.ticker = g.ticker WHERE f.tail_down IS NOT NULL GROUP BY CUBE (g.grp, year(f.session))) t",
    "a12_rank_ic": "WITH r AS (SELECT session, (rank() OVER (PARTITION BY session ORDER BY vr) + (count(*) OVER (PARTITION BY session, vr) - 1) / 2D) AS a, (rank() OVER (PARTITION BY session ORDER BY fwd) + (count(*) OVER (PARTITION BY session, fwd) - 1) / 2D) AS b FROM $features WHERE vr IS NOT NULL AND fwd IS NOT NULL) "
    "SELECT CAST(session AS STRING) AS session, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS ic FROM r GROUP BY session HAVING count(*) >= 5",
    "a13_correlations": "SELECT round(covar_pop(vr, abs(ret)) / nullif(stddev_pop(CASE WHEN ret IS NOT NULL THEN vr END) * stddev_pop(CASE WHEN vr IS NOT NULL THEN abs(ret) END), 0), 5) AS vr_ret, round(covar_pop(cl, uw) / nullif(stddev_pop(cl) * stddev_pop(uw), 0), 6) AS cl_uw, round(sum(CASE WHEN distribution AND non_progress THEN 1D ELSE 0D END) / nullif(sum(CASE WHEN distribution OR non_progress THEN 1D ELSE 0D END), 0), 6) AS jaccard FROM $features WHERE ret < 5",
    "a15_brier_log_loss": "SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM (SELECT least(0.99D, greatest(0.01D, vr / 4)) AS p, CASE WHEN tail_down THEN 1D ELSE 0D END AS y FROM $features WHERE vr IS NOT NULL AND tail_down IS NOT NULL) t",
    "a18_top_k": "SELECT CAST(session AS STRING) AS session, round(avg(fwd), 6) AS mean_fwd, round(avg(CASE WHEN fwd > 0 THEN 1D ELSE 0D END), 6) AS wins FROM (SELECT session, fwd, row_number() OVER (PARTITION BY session ORDER BY vr DESC, ticker) AS k FROM $features WHERE vr IS NOT NULL AND fwd IS NOT NULL) t WHERE k <= 5 GROUP BY session",
    "a20_nearest_rank": "SELECT ticker, round(max(CASE WHEN k = CAST(ceil(0.9D * n) AS BIGINT) THEN vr END), 6) AS p90 FROM (SELECT ticker, vr, row_number() OVER (PARTITION BY ticker ORDER BY vr) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM $features WHERE vr IS NOT NULL) t GROUP BY ticker",
    "a23_residuals": "SELECT ticker, CAST(session AS STRING) AS session, round(y - (ic + sl * x), 5) AS residual FROM (SELECT ticker, session, vr AS y, uw AS x, count(*) OVER (PARTITION BY session) AS n, regr_slope(vr, uw) OVER (PARTITION BY session) AS sl, regr_intercept(vr, uw) OVER (PARTITION BY session) AS ic, var_pop(uw) OVER (PARTITION BY session) AS v FROM $features WHERE vr IS NOT NULL AND uw IS NOT NULL) t WHERE n >= 5 AND v > 0.0001",
    "a24_drawdown_sharpe": "SELECT ticker, round(min(close / top - 1), 6) AS max_drawdown, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52D), 5) AS sharpe, round(avg(CASE WHEN r > 0 THEN 1D ELSE 0D END), 6) AS win_rate FROM (SELECT ticker, close, max(close) OVER (PARTITION BY ticker ORDER BY session ROWS UNBOUNDED PRECEDING) AS top, ret AS r FROM $features) t GROUP BY ticker",
    "a26_kish_size": "SELECT ticker, round(sum(volume) * sum(volume) / sum(volume * volume), 6) AS effective_n FROM $bars GROUP BY ticker",
    "a27_shrunk_priors": "WITH c AS (SELECT g.grp, f.ticker, sum(CASE WHEN f.tail_down THEN 1D ELSE 0D END) AS k, count(*) AS n FROM $features f JOIN $groups g ON f.ticker = g.ticker WHERE f.tail_down IS NOT NULL GROUP BY g.grp, f.ticker), "
    "p AS (SELECT grp, sum(k) / sum(n) AS rate FROM c GROUP BY grp) SELECT c.ticker, round((c.k + 252 * p.rate) / (c.n + 252), 6) AS prior FROM c JOIN p ON c.grp = p.grp",
    "a28_false_discovery": "WITH t AS (SELECT ticker, exp(-abs(avg(least(ret, 1D)) / nullif(stddev_samp(least(ret, 1D)), 0) * sqrt(CAST(count(*) AS DOUBLE)))) AS p FROM $features WHERE ret IS NOT NULL GROUP BY ticker), "
    "k AS (SELECT ticker, p, row_number() OVER (ORDER BY p, ticker) AS i, count(*) OVER () AS m FROM t) SELECT ticker, round(least(1D, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k",
    "a31_stable_sample": "SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('v1|', c_mktsegment, '|', CAST(c_custkey AS STRING)))) AS k FROM $customer) t WHERE k <= 20",
    "a33_conservation_rollup": "SELECT coalesce(l_returnflag, 'all') AS flag, count(*) AS raw, sum(CASE WHEN l_quantity >= 2 THEN 1 ELSE 0 END) + 0D AS valid, sum(CASE WHEN l_quantity < 2 THEN 1 ELSE 0 END) + 0D AS rejected FROM $lineitem GROUP BY ROLLUP (l_returnflag)",
    "a34_label_distribution": "SELECT direction, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM $features WHERE direction IS NOT NULL GROUP BY direction",
    "a35_non_overlapping_scenarios": "SELECT ticker, count(*) AS n, round(median(chg), 6) AS mid FROM (SELECT ticker, close / nullif(lag(close, 20) OVER (PARTITION BY ticker ORDER BY session), 0) - 1 AS chg, count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY session) AS back FROM $bars) t WHERE back % 20 = 0 AND chg IS NOT NULL GROUP BY ticker HAVING count(*) >= 8",
    "p01_segments_by_gap": "SELECT o_custkey, CAST(d AS STRING) AS d, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment, o_orderkey FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN datediff(CAST(o_orderdate AS DATE), lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) > 180 THEN 1 ELSE 0 END AS new FROM $orders) t",
    "p02_validity_reasons": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c_name IS NULL THEN 'invalid_row' WHEN k > 1 THEN 'duplicate_date' WHEN c_acctbal IS NULL THEN 'invalid_numeric' WHEN c_acctbal <= 0 THEN 'non_positive_price' WHEN c_acctbal > 9000 THEN 'invalid_ohlc' ELSE 'valid' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) AS k FROM $customer) t) u GROUP BY reason",
    "p03_quality_audit": "SELECT ticker, CAST(sum(CASE WHEN abs(r) > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS jumps, CAST(sum(CASE WHEN gap > 10 THEN 1 ELSE 0 END) AS DOUBLE) AS gaps FROM (SELECT ticker, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY session), 0) - 1 AS r, datediff(session, lag(session) OVER (PARTITION BY ticker ORDER BY session)) AS gap FROM $days) t GROUP BY ticker",
    "p15_hard_filters": "SELECT ticker, CAST(session AS STRING) AS session FROM $features WHERE close > sma50 AND sma50 > sma200 AND off_high >= -0.9 AND coalesce(adr_20 >= 5, true) AND coalesce(rel_20 >= 0, true) AND volume >= 10",
    "p19_bearish_evidence": "SELECT ticker, CAST(session AS STRING) AS session, CAST(least(100, CASE WHEN distribution THEN 25 ELSE 0 END + CASE WHEN close < sma20 THEN 20 ELSE 0 END + CASE WHEN vr >= 1.5 THEN 20 WHEN vr >= 1.2 THEN 12 ELSE 0 END + CASE WHEN cl <= -0.6 THEN 10 ELSE 0 END + CASE WHEN sv <= -1 THEN 10 ELSE 0 END + CASE WHEN rel_20 <= -0.05 THEN 5 ELSE 0 END + CASE WHEN failed_breakout THEN 10 ELSE 0 END) AS DOUBLE) AS score FROM $features",
    "w05_sigmoid_strength": "SELECT ticker, CAST(session AS STRING) AS session, round(100 / (1 + exp(-6 * least(5D, greatest(-5D, 0.5D * rel_20 + 0.5D * rel_5)))), 6) AS score FROM $features WHERE rel_20 IS NOT NULL",
    "w13_overheat": "SELECT ticker, CAST(session AS STRING) AS session, round(least(100D, least(greatest(ext_ma20, 0D) * 2, 30D) + least(greatest(chg_20 * 100, 0D) * 0.8D, 30D) + least(greatest(chg_10 * close / nullif(atr14, 0), 0D) * 4, 25D)), 6) AS overheat FROM $features WHERE ext_ma20 IS NOT NULL AND chg_20 IS NOT NULL AND atr14 IS NOT NULL",
    "w34_non_overlap": "SELECT ticker, CAST(session AS STRING) AS session FROM (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY session) - 1 AS k FROM $features WHERE fwd IS NOT NULL) t WHERE k % 5 = 0",
    "w36_event_study": "SELECT ticker, CAST(session AS STRING) AS session, round(x5 - m5, 5) AS car FROM (SELECT ticker, session, pivot_breakout, lead(close, 5) OVER (PARTITION BY ticker ORDER BY session) / nullif(entry, 0) - 1 AS x5, lead(m_close, 5) OVER (PARTITION BY ticker ORDER BY session) / nullif(lead(m_open, 1) OVER (PARTITION BY ticker ORDER BY session), 0) - 1 AS m5 FROM $features) t WHERE pivot_breakout AND x5 IS NOT NULL AND x5 < 100",
    "w37_latest_version": "SELECT ticker, CAST(effective_from AS STRING) AS effective_from, version FROM (SELECT ticker, effective_from, version, row_number() OVER (PARTITION BY ticker ORDER BY effective_from DESC, version DESC) AS k FROM $members) t WHERE k = 1",
    "w39_calendar_change": "SELECT ticker, CAST(session AS STRING) AS session, round(close / nullif(last_value(close) OVER (PARTITION BY ticker ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING), 0) - 1, 5) AS chg FROM (SELECT ticker, session, close, datediff(session, DATE '1970-01-01') AS d FROM $days) t",
    "w46_technical_label": "SELECT ticker, CAST(session AS STRING) AS session, CASE WHEN sma200 IS NULL THEN 'unavailable' WHEN close > sma20 AND sma20 > sma50 AND sma50 > sma200 THEN 'strong' WHEN close > sma50 THEN 'constructive' WHEN close > sma200 THEN 'weakening' ELSE 'weak' END AS label FROM $features",
    "x10_distribution_with_removal": "WITH d AS (SELECT ticker, session, pos, close, distribution FROM $features), e AS (SELECT d.ticker, d.pos, d.close AS base, d.pos + k.n AS at FROM d JOIN (" + _numbers(0, 24) + ") k ON k.n IS NOT NULL WHERE d.distribution), "
    "j AS (SELECT e.ticker, i.session, e.base, max(CASE WHEN i.pos > e.pos THEN i.close END) OVER (PARTITION BY e.ticker, e.pos ORDER BY i.pos ROWS UNBOUNDED PRECEDING) AS top FROM e JOIN d i ON i.ticker = e.ticker AND i.pos = e.at) "
    "SELECT ticker, CAST(session AS STRING) AS session, count(*) AS active FROM j WHERE top IS NULL OR top < 1.05D * base GROUP BY ticker, session",
    "x20_islands": "WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS code, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = o_orderstatus THEN 0 ELSE 1 END AS new FROM $orders), i AS (SELECT o_custkey, d, code, sum(new) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM s), "
    "g AS (SELECT o_custkey, island, min(code) AS code, min(d) AS valid_from FROM i GROUP BY o_custkey, island) SELECT o_custkey, code, CAST(valid_from AS STRING) AS valid_from, CAST(lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY island) AS STRING) AS valid_to FROM g",
    "x22_overlap_audit": "SELECT ticker, CAST(effective_from AS STRING) AS effective_from, coalesce(effective_from < before, false) AS overlaps FROM (SELECT ticker, effective_from, max(coalesce(effective_to, DATE '9999-12-31')) OVER (PARTITION BY ticker ORDER BY effective_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM $members) t",
    "x24_transitions": "SELECT ticker, CAST(session AS STRING) AS session, above FROM (SELECT ticker, session, close > sma20 AS above, lag(close > sma20) OVER (PARTITION BY ticker ORDER BY session) AS was FROM $features WHERE sma20 IS NOT NULL) t WHERE was IS NULL OR was <> above",
    "t02_top_k_per_group": "SELECT ticker, CAST(session AS STRING) AS session, k FROM (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY volume DESC, session) AS k FROM $bars) t WHERE k <= 3",
    "u02_u03_set_operations": "SELECT CAST(session AS STRING) AS session, 'both' AS side FROM (SELECT session FROM $bars WHERE ticker = 'Brand#1' INTERSECT SELECT session FROM $bars WHERE ticker = 'Brand#2') a UNION ALL SELECT CAST(session AS STRING), 'first' FROM (SELECT session FROM $bars WHERE ticker = 'Brand#1' EXCEPT SELECT session FROM $bars WHERE ticker = 'Brand#2') b",
    "s03_last_n_bars": "SELECT ticker, CAST(session AS STRING) AS session FROM (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM $days) t WHERE k <= 260",
    "r07_order_flow": "SELECT symbol, round(100 * (buy - sell) / nullif(buy + sell, 0), 2) AS pressure, round((buy + sell) / total, 6) AS coverage FROM (SELECT symbol, sum(CASE WHEN d > 0 THEN size + 0D ELSE 0D END) AS buy, sum(CASE WHEN d < 0 THEN size + 0D ELSE 0D END) AS sell, sum(size + 0D) AS total FROM (SELECT symbol, size, price - lag(price) OVER (PARTITION BY symbol ORDER BY ns, event_id) AS d FROM $trades WHERE kind = 'trade') t GROUP BY symbol) u",
    "r08_latest_quote": "SELECT symbol, ns, price FROM (SELECT symbol, ns, price, row_number() OVER (PARTITION BY symbol ORDER BY ns DESC, event_id DESC) AS k FROM $trades WHERE kind = 'quote') t WHERE k = 1",
}

_SCORED = (
    "WITH x AS (SELECT f.ticker, f.session, f.close, f.sma50, f.off_high, f.off_low, f.adr_20, f.dollar_volume_20, f.vr, f.volume, f.mean_volume_50, f.over_pivot, f.pivot_breakout, f.pocket_pivot, f.m_chg_20, e.ema10, e.ema20, e.ema50, s.rating AS rs, "
    "least(100D, least(greatest(f.ext_ma20, 0D) * 2, 30D) + least(greatest(f.chg_20 * 100, 0D) * 0.8D, 30D) + least(greatest(f.chg_10 * f.close / nullif(f.atr14, 0), 0D) * 4, 25D)) AS overheat "
    "FROM $features f JOIN $emas e ON f.ticker = e.ticker AND f.session = e.session JOIN $strong s ON f.ticker = s.ticker AND f.session = s.session WHERE s.rating IS NOT NULL), "
    "y AS (SELECT *, CASE WHEN m_chg_20 > 0 THEN 11D ELSE 0D END + CASE WHEN rs >= 95 THEN 9D WHEN rs >= 85 THEN 6D WHEN rs >= 70 THEN 3D ELSE 0D END AS s_market, "
    "least(15D, CASE WHEN rs >= 98 THEN 8D WHEN rs >= 95 THEN 6D WHEN rs >= 90 THEN 4D WHEN rs >= 80 THEN 2D ELSE 0D END + CASE WHEN ema10 > ema20 AND ema20 > sma50 THEN 4D ELSE 0D END + CASE WHEN off_high > -0.10 THEN 3D ELSE 0D END) AS s_trend, "
    "least(15D, CASE WHEN volume / nullif(mean_volume_50, 0) >= 1.8 THEN 7D WHEN volume / nullif(mean_volume_50, 0) >= 1.4 THEN 5D WHEN volume / nullif(mean_volume_50, 0) >= 1.0 THEN 2D ELSE 0D END + CASE WHEN pivot_breakout THEN 3D ELSE 0D END + CASE WHEN over_pivot >= 0 AND over_pivot <= 5 THEN 3D ELSE 0D END + CASE WHEN pocket_pivot THEN 2D ELSE 0D END) AS s_breakout, "
    "CASE WHEN volume / nullif(mean_volume_50, 0) > 1.2 THEN 3D ELSE 2D END AS s_institution, least(5D, 2.5D + CASE WHEN off_high < -0.05 THEN 1.5D ELSE 0D END + CASE WHEN adr_20 < 6 THEN 1D ELSE 0D END) AS s_reward, "
    "close > 10 AND close > ema50 AND ema10 > ema20 AND rs > 90 AND dollar_volume_20 > 50000 AND coalesce(off_low > 0.7, true) AND coalesce(off_high > -0.2, true) AS passed FROM x) "
)

def _luhn(digits: str) -> str:
    """Whether the text of 14 digits passes the Luhn check: from the right, every second digit doubled."""
    terms = []
    for i in range(1, 15):
        d = f"CAST(substring({digits}, {i}, 1) AS INT)"
        terms.append(f"CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END" if i % 2 else d)
    return "(" + " + ".join(terms) + ") % 10 = 0"


#: Demand sessions remembered for 120 sessions with a half-life of 40, until a close falls three percent under their low.
_DEMAND = (
    "WITH d AS (SELECT ticker, session, pos, close, low, cl, vr FROM $features), e AS (SELECT d.ticker, d.pos, d.low AS level, d.pos + k.n AS at, k.n AS age FROM d JOIN (" + _numbers(1, 120) + ") k ON k.n IS NOT NULL WHERE d.vr >= 1.2 AND d.cl >= 0.4), "
    "j AS (SELECT e.ticker, e.level, e.age, i.session, i.close, min(i.close) OVER (PARTITION BY e.ticker, e.pos ORDER BY i.pos ROWS UNBOUNDED PRECEDING) AS worst FROM e JOIN d i ON i.ticker = e.ticker AND i.pos = e.at), "
    "r AS (SELECT ticker, session, count(*) AS n, sum(power(0.5D, age / 40D)) AS strength, max(CASE WHEN level <= close THEN level END) AS nearest FROM j WHERE worst >= 0.97D * level GROUP BY ticker, session) "
)

#: Monthly series by order priority with a first release after 15 days and a revision after 60; replay dates and what each sees.
_MACRO = (
    "WITH base AS (SELECT substring(o_orderpriority, 1, 1) AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs, avg(o_totalprice) / 10000 AS value FROM $orders GROUP BY substring(o_orderpriority, 1, 1), CAST(date_trunc('month', o_orderdate) AS DATE)), "
    "v AS (SELECT series, obs, value, date_add(obs, 45) AS known FROM base UNION ALL SELECT series, obs, value * 1.01D, date_add(obs, 90) FROM base), d AS (SELECT DISTINCT date_add(obs, 27) AS seen_at FROM base), "
    "latest AS (SELECT d.seen_at, v.series, v.obs, v.value, dense_rank() OVER (PARTITION BY d.seen_at, v.series ORDER BY v.obs DESC) AS back, row_number() OVER (PARTITION BY d.seen_at, v.series ORDER BY v.obs DESC, v.known DESC) AS k, row_number() OVER (PARTITION BY d.seen_at, v.series, v.obs ORDER BY v.known DESC) AS newest FROM d JOIN v ON v.known <= d.seen_at), "
    "w AS (SELECT seen_at, count(DISTINCT series) AS n_series, "
    + ", ".join(f"max(CASE WHEN series = '{i}' AND back = 1 AND newest = 1 THEN value END) AS v{i}, max(CASE WHEN series = '{i}' AND back = 4 AND newest = 1 THEN value END) AS p{i}" for i in (1, 2, 3, 4))
    + " FROM latest WHERE back <= 4 GROUP BY seen_at) "
)

TEXTS |= {
    "p16_dimension_scores": _SCORED + "SELECT ticker, CAST(session AS STRING) AS session, s_market, s_trend, s_breakout, s_institution, s_reward FROM y",
    "p17_total_and_grade": _SCORED + "SELECT ticker, CAST(session AS STRING) AS session, round(t, 4) AS total, CASE WHEN NOT passed THEN 'unfiltered' WHEN t >= 85 THEN 'A' WHEN t >= 75 THEN 'B' WHEN t >= 65 THEN 'C' ELSE 'out' END AS grade FROM (SELECT ticker, session, passed, greatest(0D, (s_market + s_trend + s_breakout + s_institution + s_reward) / 60 * 100 - CASE WHEN overheat IS NULL THEN 0D ELSE least(greatest(overheat - 40, 0D) / 60 * 25, 25D) END) AS t FROM y) z",
    "p15b_must_and_optional_filters": _SCORED + "SELECT ticker, CAST(session AS STRING) AS session FROM y WHERE passed",
    "p24_breakout_evidence": "SELECT ticker, CAST(session AS STRING) AS session, coalesce(over_pivot > 0 AND over_pivot <= 5, false) AS in_buy_zone, coalesce(volume / nullif(mean_volume_50, 0) >= 1.4, false) AS volume_confirmed FROM $features WHERE pivot_breakout",
    "p25_p26_rule_points": "SELECT ticker, CAST(session AS STRING) AS session, pts, avail, round(CASE WHEN avail / 40 >= 0.8 THEN pts / avail * 100 END, 6) AS score FROM (SELECT ticker, session, CASE WHEN chg_20 <= -0.05 THEN 20D WHEN chg_20 <= 0 THEN 10D ELSE 0D END + CASE WHEN rel_20 <= -0.03 THEN 20D WHEN rel_20 <= 0 THEN 10D ELSE 0D END AS pts, CASE WHEN chg_20 IS NOT NULL THEN 20D ELSE 0D END + CASE WHEN rel_20 IS NOT NULL THEN 20D ELSE 0D END AS avail FROM $features) t",
    "p27_nullable_boolean": "SELECT ticker, CAST(session AS STRING) AS session, CASE WHEN count(ret) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN CASE WHEN ret > 0 THEN 1D ELSE 0D END END AS up_when_known FROM $features",
    "p29_code_ranges": "SELECT sector, count(*) AS n FROM (SELECT CASE WHEN code BETWEEN 100 AND 999 THEN 'agriculture' WHEN code BETWEEN 1000 AND 1499 THEN 'mining' WHEN code IN (2834, 2836) THEN 'pharma' WHEN code BETWEEN 2000 AND 3999 THEN 'manufacturing' WHEN code BETWEEN 4000 AND 4999 THEN 'utilities' WHEN code BETWEEN 6000 AND 6799 THEN 'finance' ELSE 'other' END AS sector FROM (SELECT (p_partkey * 37) % 9000 AS code FROM $part) t) u GROUP BY sector",
    "p30_ticker_normalisation": "SELECT DISTINCT upper(trim(replace(p_brand, '#', '.'))) AS ticker FROM $part WHERE length(trim(p_brand)) > 0",
    "a11_multi_class_metrics": "SELECT direction, count(*) AS n, round(avg(CASE WHEN guess = direction THEN 1D ELSE 0D END), 6) AS recall_ FROM (SELECT direction, CASE WHEN cl > 0.3 THEN 'up' WHEN cl < -0.3 THEN 'down' ELSE 'neutral' END AS guess FROM $features WHERE direction IS NOT NULL AND cl IS NOT NULL) t GROUP BY direction",
    "a22_compounded_return": "SELECT ticker, CAST(session AS STRING) AS session, round(exp(s) - 1, 4) AS compounded FROM (SELECT ticker, session, CASE WHEN count(l) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN sum(l) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS s FROM (SELECT ticker, session, ln(1 + least(ret, 1D)) AS l FROM $features WHERE ret > -1) t) u WHERE s IS NOT NULL",
    "a25_period_description": "SELECT ticker, y AS year, n, round(last / first - 1, 5) AS total_return, round(worst, 6) AS max_drawdown FROM (SELECT ticker, year(session) AS y, count(*) AS n, max(CASE WHEN k = 1 THEN close END) AS first, max(CASE WHEN z = 1 THEN close END) AS last, min(close / top - 1) AS worst FROM (SELECT ticker, session, close, row_number() OVER (PARTITION BY ticker, year(session) ORDER BY session) AS k, row_number() OVER (PARTITION BY ticker, year(session) ORDER BY session DESC) AS z, max(close) OVER (PARTITION BY ticker, year(session) ORDER BY session ROWS UNBOUNDED PRECEDING) AS top FROM $bars) t GROUP BY ticker, year(session)) u",
    "a29_t_statistics": "SELECT ticker, count(*) AS n, round(avg(v) / nullif(stddev_samp(v) / sqrt(count(*) + 0D), 0), 6) AS t FROM (SELECT ticker, least(fwd, 1D) AS v FROM $features WHERE fwd IS NOT NULL) x GROUP BY ticker",
    "a32_quota_cohort": "SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 3 END ORDER BY CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END, md5(CAST(c_custkey AS STRING))) AS k FROM $customer) t WHERE k <= 40",
    "a36_evidence_coverage": "SELECT ticker, round(avg(CASE WHEN vr IS NOT NULL THEN 1D ELSE 0D END), 6) AS vr, round(avg(CASE WHEN cl IS NOT NULL THEN 1D ELSE 0D END), 6) AS cl, round(avg(CASE WHEN sma200 IS NOT NULL THEN 1D ELSE 0D END), 6) AS sma200, round(avg(CASE WHEN rel_20 IS NOT NULL THEN 1D ELSE 0D END), 6) AS rel_20 FROM $features GROUP BY ticker",
    "w20_high_level_distribution": "WITH c AS (SELECT ticker, session, CASE WHEN chg_60 >= 0.20 THEN 30D ELSE 0D END + CASE WHEN off_high >= -0.15 THEN 25D ELSE 0D END + CASE WHEN close > sma50 THEN 20D ELSE 0D END + CASE WHEN (close - sma20) / nullif(atr20, 0) >= 1 THEN 25D ELSE 0D END AS context, "
    "least(40D, CASE WHEN distribution THEN 25D ELSE 0D END + CASE WHEN non_progress THEN 15D ELSE 0D END + CASE WHEN sv <= -0.75 THEN 15D ELSE 0D END + CASE WHEN cl <= -0.5 THEN 10D ELSE 0D END + CASE WHEN churn_10 >= 2 THEN 15D ELSE 0D END + CASE WHEN distribution_10 >= 2 THEN 15D ELSE 0D END) + least(30D, CASE WHEN uw >= 0.35 AND vr >= 1.2 THEN 15D ELSE 0D END + CASE WHEN failed_breakout THEN 20D ELSE 0D END + CASE WHEN failed_10 >= 2 THEN 10D ELSE 0D END) AS supply, "
    "CASE WHEN close < sma20 THEN 30D ELSE 0D END + CASE WHEN close < sma50 THEN 25D ELSE 0D END + CASE WHEN chg_20 <= -0.10 THEN 25D ELSE 0D END AS structure FROM $features WHERE sma50 IS NOT NULL), m AS (SELECT *, max(context) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS top FROM c) "
    "SELECT ticker, CAST(session AS STRING) AS session, top AS context, round(0.35D * top + 0.40D * supply + 0.25D * structure, 6) AS raw, CASE WHEN top < 60 THEN 'inactive' WHEN supply >= 40 AND structure >= 40 THEN 'confirmed' WHEN supply >= 40 THEN 'distribution' ELSE 'watch' END AS state FROM m",
    "w22_group_stress": "WITH g AS (SELECT g.grp, f.session, count(*) AS n, avg(f.rel_5) AS rel, avg(CASE WHEN f.close > f.sma20 THEN 1D ELSE 0D END) AS above, avg(CASE WHEN f.ret < 0 AND f.vr > 1 THEN 1D ELSE 0D END) AS down, avg(CASE WHEN f.distribution THEN 1D ELSE 0D END) AS dist, avg(f.vr) AS mvr FROM $features f JOIN $groups g ON f.ticker = g.ticker WHERE f.sma20 IS NOT NULL GROUP BY g.grp, f.session HAVING count(*) >= 3) "
    "SELECT grp, CAST(session AS STRING) AS session, n, CASE WHEN rel <= -0.03 THEN 20D WHEN rel <= -0.015 THEN 10D ELSE 0D END + CASE WHEN above <= 0.45 THEN 20D WHEN above <= 0.60 THEN 10D ELSE 0D END + CASE WHEN down >= 0.60 THEN 15D WHEN down >= 0.40 THEN 7.5D ELSE 0D END + CASE WHEN dist >= 0.30 THEN 20D WHEN dist >= 0.15 THEN 10D ELSE 0D END + CASE WHEN mvr >= 1.30 THEN 10D WHEN mvr >= 1.10 THEN 5D ELSE 0D END AS stress FROM g",
    "w24_agreement": "SELECT ticker, CAST(session AS STRING) AS session, round(abs(chg_5) * (sign(chg_5) * sign(m_chg_5) + sign(chg_5) * sign(rel_5)) / 2, 5) AS agreement FROM $features WHERE chg_5 IS NOT NULL AND m_chg_5 IS NOT NULL",
    "w31_relative_target": "SELECT f.ticker, CAST(f.session AS STRING) AS session, round(f.fwd - (z.m_close / nullif(a.m_open, 0) - 1), 5) AS excess FROM (SELECT ticker, session, fwd, label_end, lead(session) OVER (PARTITION BY ticker ORDER BY session) AS entry_day FROM $features) f JOIN $market a ON a.session = f.entry_day JOIN $market z ON z.session = f.label_end WHERE f.fwd IS NOT NULL",
    "w32_market_outcomes": "SELECT CAST(session AS STRING) AS session, CASE WHEN x IS NULL THEN NULL WHEN x > 0.02 THEN 1D ELSE 0D END AS opportunity, CASE WHEN lo IS NULL THEN NULL WHEN lo < -0.05 THEN 1D ELSE 0D END AS risk FROM (SELECT session, lead(m_close, 5) OVER (ORDER BY session) / nullif(m_close, 0) - 1 AS x, CASE WHEN count(m_close) OVER (ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN min(m_close) OVER (ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / nullif(m_close, 0) - 1 END AS lo FROM $market) t",
    "w43_crosses_when_known": "SELECT ticker, CAST(session AS STRING) AS session, CASE WHEN sma50 IS NULL OR p IS NULL OR ps IS NULL THEN NULL WHEN p <= ps AND close > sma50 THEN 1D ELSE 0D END AS crossed_above FROM (SELECT ticker, session, close, sma50, lag(close) OVER (PARTITION BY ticker ORDER BY session) AS p, lag(sma50) OVER (PARTITION BY ticker ORDER BY session) AS ps FROM $features) t",
    "w45_bottom_screen": "SELECT ticker, CAST(session AS STRING) AS session, recent_capitulation, reclaimed FROM (SELECT ticker, session, k, max(CASE WHEN vr >= 1.5 AND ret < 0 AND cl <= -0.5 THEN 1D ELSE 0D END) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent_capitulation, max(CASE WHEN cross_up AND vr >= 1.1 THEN 1D ELSE 0D END) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS reclaimed FROM (SELECT ticker, session, vr, ret, cl, cross_up, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM $features) u WHERE k <= 90) t WHERE k = 1",
    "x15_early_reversal": "SELECT ticker, CAST(session AS STRING) AS session, score, CASE WHEN a AND b AND score >= 75 THEN 'watch' ELSE 'none' END AS state FROM (SELECT ticker, session, coalesce(low > low_before, false) AS a, coalesce(cross_up, false) AS b, CASE WHEN low > low_before THEN 25D ELSE 0D END + CASE WHEN cross_up THEN 25D ELSE 0D END + CASE WHEN vr >= 1.2 AND ret > 0 THEN 25D ELSE 0D END + CASE WHEN rel_5 > 0 THEN 25D ELSE 0D END AS score FROM (SELECT *, min(low) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 6 PRECEDING) AS low_before FROM $features) t) u",
    "g07_unified_risk": "SELECT source, count(*) AS n, round(avg(CASE WHEN flag = y THEN 1D ELSE 0D END), 6) AS accuracy, round(avg(CASE WHEN flag THEN 1D ELSE 0D END), 6) AS signal_rate FROM (SELECT 'individual' AS source, distribution AS flag, tail_down AS y FROM $features WHERE tail_down IS NOT NULL UNION ALL SELECT 'slow', coalesce(chg_20 <= -0.05, false), tail_down FROM $features WHERE tail_down IS NOT NULL UNION ALL SELECT 'any', distribution OR coalesce(chg_20 <= -0.05, false), tail_down FROM $features WHERE tail_down IS NOT NULL) t GROUP BY source",
    "g08_state_outcomes": "SELECT state, count(*) AS n, round(avg(CASE WHEN tail_down THEN 1D ELSE 0D END), 6) AS tail_rate, round(avg(least(mfe, 5D)), 5) AS mean_mfe FROM (SELECT CASE WHEN close > sma50 AND sma20 > sma50 THEN 'uptrend' WHEN close < sma50 THEN 'below' ELSE 'mixed' END AS state, tail_down, mfe FROM $features WHERE sma50 IS NOT NULL AND tail_down IS NOT NULL) t GROUP BY state",
    "g09_universe_rows": "SELECT ticker, CAST(session AS STRING) AS session, round(close, 8) AS close, round(off_high, 6) AS off_high, round(pct, 6) AS momentum_pct FROM (SELECT ticker, session, close, off_high, CASE WHEN mom_63 IS NOT NULL THEN (rank() OVER (PARTITION BY mom_63 IS NULL ORDER BY mom_63) + (count(*) OVER (PARTITION BY mom_63) - 1) / 2D) / count(mom_63) OVER () END AS pct FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM $features) t WHERE k = 1) u",
    "g10_monitor_difference": "SELECT ticker, CAST(session AS STRING) AS session, label, was FROM (SELECT ticker, session, k, label, lead(label) OVER (PARTITION BY ticker ORDER BY k) AS was FROM (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k, CASE WHEN close > sma50 THEN 'above' ELSE 'below' END AS label FROM $features WHERE sma50 IS NOT NULL) t WHERE k <= 2) u WHERE k = 1",
    "m10_recency_weights": "SELECT ticker, round(sum(w), 5) AS total, round(sum(w * CASE WHEN tail_down THEN 1D ELSE 0D END) / sum(w), 6) AS rate FROM (SELECT ticker, tail_down, power(0.5D, datediff(DATE '2002-01-01', session) / 252D) AS w FROM $features WHERE tail_down IS NOT NULL) t GROUP BY ticker",
    "r12_liveness": "SELECT symbol, CASE WHEN newest - last > 86400000000000 THEN 'stale' WHEN newest - last > 3600000000000 THEN 'pending' ELSE 'live' END AS state FROM (SELECT symbol, max(ns) AS last FROM $trades GROUP BY symbol) t CROSS JOIN (SELECT max(ns) AS newest FROM $trades) u",
    "g02_visible_vintages": _MACRO + "SELECT CAST(seen_at AS STRING) AS seen_at, series, CAST(obs AS STRING) AS obs, round(value, 6) AS value FROM latest WHERE k = 1",
    "w40_policy_directions": _MACRO + "SELECT CAST(seen_at AS STRING) AS seen_at, CASE WHEN p1 IS NULL THEN 'unavailable' WHEN v1 > p1 + 0.05 THEN 'tightening' WHEN v1 < p1 - 0.05 THEN 'easing' ELSE 'flat' END AS rates, CASE WHEN p2 IS NULL THEN 'unavailable' WHEN v2 > p2 THEN 'up' ELSE 'down' END AS oil FROM w",
    "w44_yearly_inflation": "SELECT CAST(a.mth AS STRING) AS month, round(a.v / nullif(b.v, 0) - 1, 6) AS yoy FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mth, avg(o_totalprice) AS v FROM $orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)) a JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mth, avg(o_totalprice) AS v FROM $orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)) b ON year(a.mth) = year(b.mth) + 1 AND month(a.mth) = month(b.mth)",
    "p21_decision_ladder": "SELECT ticker, CAST(session AS STRING) AS session, CASE WHEN score >= 70 THEN 'immediate' WHEN high_level AND score >= 40 THEN 'confluence' WHEN high_level THEN 'high' WHEN score >= 40 THEN 'watch' ELSE 'none' END AS decision, CASE WHEN score >= 70 THEN 'down' WHEN score >= 40 AND chg_20 > 0 THEN 'neutral' WHEN chg_20 > 0.01 THEN 'up' WHEN chg_20 < -0.01 THEN 'down' ELSE 'neutral' END AS final_direction FROM (SELECT ticker, session, chg_20, coalesce(chg_60 >= 0.20 AND off_high >= -0.15, false) AS high_level, CASE WHEN distribution THEN 25 ELSE 0 END + CASE WHEN close < sma20 THEN 20 ELSE 0 END + CASE WHEN vr >= 1.5 THEN 20 WHEN vr >= 1.2 THEN 12 ELSE 0 END + CASE WHEN cl <= -0.6 THEN 10 ELSE 0 END + CASE WHEN sv <= -1 THEN 10 ELSE 0 END AS score FROM $features) t",
    "g05_risk_context_panel": "SELECT f.ticker, CAST(f.session AS STRING) AS session, greatest(CASE WHEN f.distribution THEN 60D ELSE 0D END, coalesce(g.stress, 0D)) AS risk, g.n FROM $features f LEFT JOIN (SELECT x.grp, y.session, count(*) AS n, 100 * avg(CASE WHEN y.close < y.sma20 THEN 1D ELSE 0D END) AS stress FROM $features y JOIN $groups x ON x.ticker = y.ticker WHERE y.sma20 IS NOT NULL GROUP BY x.grp, y.session HAVING count(*) >= 3) g ON g.session = f.session AND g.grp = substring(f.ticker, 7, 1) WHERE g.n IS NOT NULL",
    "j15_tiered_controls": "WITH e AS (SELECT ticker, session, off_high, vol_63 FROM $features WHERE pivot_breakout AND vol_63 IS NOT NULL AND off_high IS NOT NULL), c AS (SELECT ticker, session, off_high, vol_63 FROM $features WHERE NOT pivot_breakout AND vol_63 IS NOT NULL AND off_high IS NOT NULL), "
    "p AS (SELECT e.ticker, e.session, c.ticker AS control_ticker, c.session AS control, CASE WHEN c.ticker = e.ticker THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY e.ticker, e.session ORDER BY CASE WHEN c.ticker = e.ticker THEN 1 ELSE 2 END, abs(datediff(c.session, e.session)), round(abs(e.off_high - c.off_high), 9), c.ticker, c.session) AS k FROM (SELECT e.*, " + NEAR_63[0] + " AS near FROM e) e JOIN " + NEAR_63[1] + " c ON substring(c.ticker, 7, 1) = substring(e.ticker, 7, 1) AND e.near = c.near AND " + NEAR_63[2] + ") "
    "SELECT ticker, CAST(session AS STRING) AS session, control_ticker, CAST(control AS STRING) AS control, tier FROM p WHERE k = 1",
    "x23_monthly_reclassification": "SELECT ticker, CAST(effective AS STRING) AS effective, CAST(date_add(effective, 45) AS STRING) AS expires, CASE WHEN b >= 1 THEN 'cyclical' WHEN b >= 0 THEN 'core' ELSE 'defensive' END AS class FROM (SELECT ticker, session, lead(session) OVER (PARTITION BY ticker ORDER BY session) AS effective, beta_63 AS b, row_number() OVER (PARTITION BY ticker, year(session), month(session) ORDER BY session DESC) AS k FROM $features) t WHERE k = 1 AND b IS NOT NULL AND effective IS NOT NULL",
    "x21_assignment_intervals": "WITH s AS (SELECT ticker, session, CASE WHEN beta_63 >= 1 THEN 'cyclical' ELSE 'core' END AS code FROM $features WHERE beta_63 IS NOT NULL), i AS (SELECT ticker, session, code, sum(new) OVER (PARTITION BY ticker ORDER BY session ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY ticker ORDER BY session) = code THEN 0 ELSE 1 END AS new FROM s) t), "
    "g AS (SELECT ticker, island, min(code) AS code, min(session) AS a FROM i GROUP BY ticker, island) SELECT ticker, code, CAST(a AS STRING) AS effective_from, CAST(lead(a) OVER (PARTITION BY ticker ORDER BY a) AS STRING) AS effective_to FROM g",
    "a21b_best_group_by_residual": "WITH m AS (SELECT g.grp, f.session, avg(f.chg_5) AS gc FROM $features f JOIN $groups g ON f.ticker = g.ticker WHERE f.chg_5 < 5 GROUP BY g.grp, f.session), c AS (SELECT f.ticker, m.grp, covar_pop(f.chg_5 - f.m_chg_5, m.gc - f.m_chg_5) / nullif(stddev_pop(f.chg_5 - f.m_chg_5) * stddev_pop(m.gc - f.m_chg_5), 0) AS r FROM $features f JOIN m ON m.session = f.session WHERE f.chg_5 < 5 AND f.m_chg_5 IS NOT NULL GROUP BY f.ticker, m.grp) "
    "SELECT ticker, grp, round(r, 5) AS r FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY r DESC, grp) AS k FROM c) t WHERE k = 1",
    "p28_isin_check": "SELECT p_partkey, concat('US', body, tail) AS isin, " + _luhn("concat('3028', body, tail)") + " AS valid FROM (SELECT p_partkey, lpad(CAST((p_partkey * 7919) % 1000000000 AS STRING), 9, '0') AS body, CAST(p_partkey % 10 AS STRING) AS tail FROM $part) t",
    "s04_last_n_by_row_number": "SELECT ticker, CAST(session AS STRING) AS session, k FROM (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM $bars WHERE ticker IN ('Brand#1', 'Brand#2', 'Brand#3')) t WHERE k <= 30",
    "s05_latest_segment": "SELECT o_custkey, o_orderkey, CAST(segment AS BIGINT) AS segment FROM (SELECT *, max(segment) OVER (PARTITION BY o_custkey) AS top FROM (SELECT o_custkey, o_orderkey, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN datediff(CAST(o_orderdate AS DATE), lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) > 180 THEN 1 ELSE 0 END AS new FROM $orders) t) u) v WHERE segment = top",
    "s01_one_ticker_history": "SELECT ticker, CAST(session AS STRING) AS session, round(close, 8) AS close FROM $bars WHERE ticker = 'Brand#7' AND session BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
    "t04_prune_oldest": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM $orders) t WHERE k > 5",
    "t05_argmax_tuple": "SELECT ticker, CAST(session AS STRING) AS session FROM (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY distribution_20 DESC, volume DESC, session DESC) AS k FROM $features WHERE distribution_20 IS NOT NULL) t WHERE k = 1",
    "u05_pool_with_limits": "SELECT ticker, source FROM (SELECT ticker, source, row_number() OVER (ORDER BY pri, rnk, ticker) AS place FROM (SELECT ticker, source, pri, rnk, row_number() OVER (PARTITION BY ticker ORDER BY pri, rnk) AS seen FROM (SELECT 'Brand#1' AS ticker, 'fixed' AS source, 0 AS pri, 1 AS rnk UNION ALL SELECT ticker, 'peer', 1, rnk FROM (SELECT ticker, row_number() OVER (ORDER BY ticker) AS rnk FROM $groups WHERE grp = '1') p WHERE rnk <= 16 UNION ALL SELECT ticker, 'candidate', 2, rnk FROM (SELECT ticker, row_number() OVER (ORDER BY mean_v DESC, ticker) AS rnk FROM (SELECT ticker, avg(volume) AS mean_v FROM $bars GROUP BY ticker) m) c WHERE rnk <= 10) a) b WHERE seen = 1) d WHERE place <= 30",
    "u06_pool_overlay": "SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(b.state, 'included') AS state FROM (SELECT ticker FROM $groups WHERE grp = '2') a FULL OUTER JOIN (SELECT 'Brand#20' AS ticker, 'excluded' AS state UNION ALL SELECT 'Brand#9', 'added') b ON a.ticker = b.ticker",
    "w25_feature_frame": "SELECT ticker, CAST(session AS STRING) AS session, round(chg_5, 5) AS chg_5, round(chg_20, 5) AS chg_20, round(chg_60, 5) AS chg_60, round(vr, 6) AS vr, round(cl, 6) AS cl, round(uw, 6) AS uw, round(lw, 6) AS lw, round(sv, 6) AS sv, round(vol_63, 5) AS vol_63, round(off_high, 6) AS off_high, round(rel_5, 5) AS rel_5, round(rel_20, 5) AS rel_20, round(ext_ma20, 4) AS ext_ma20, round(atr20 / nullif(close, 0), 5) AS range_share, round(m_chg_5, 5) AS m_chg_5, round(m_chg_20, 5) AS m_chg_20 FROM $features",
    "w26_market_context": "SELECT CAST(session AS STRING) AS session, n, round(100 * (0.4D * above + 0.3D * rising + 0.3D * (1 - dist)), 5) AS opportunity, round(100 * (0.5D * (1 - above) + 0.5D * dist), 5) AS risk FROM (SELECT session, count(*) AS n, avg(CASE WHEN close > sma50 THEN 1D ELSE 0D END) AS above, avg(CASE WHEN chg_20 > 0 THEN 1D ELSE 0D END) AS rising, avg(CASE WHEN distribution THEN 1D ELSE 0D END) AS dist FROM $features WHERE sma50 IS NOT NULL GROUP BY session HAVING count(*) >= 5) t",
    "m08_boundary_grid": "SELECT cut / 10D AS cut, n, round(hit, 6) AS hit, row_number() OVER (ORDER BY hit DESC, cut) AS place FROM (SELECT g.cut, count(*) AS n, avg(CASE WHEN f.tail_down THEN 1D ELSE 0D END) AS hit FROM $features f JOIN (SELECT 10 AS cut UNION ALL SELECT 12 UNION ALL SELECT 15 UNION ALL SELECT 18 UNION ALL SELECT 20 UNION ALL SELECT 25) g ON f.vr >= g.cut / 10D WHERE f.tail_down IS NOT NULL GROUP BY g.cut) t",
    "m11_frozen_linear_scores": "SELECT ticker, CAST(session AS STRING) AS session, round(0.1D + 0.5D * coalesce(vr, 1D) - 0.2D * coalesce(cl, 0D) + 0.3D * coalesce(least(rel_20, 5D), 0D), 5) AS score FROM $features",
    "g03_period_returns": "SELECT id, ticker, n, round(last / first - 1, 5) AS total_return FROM (SELECT p.id, b.ticker, count(*) AS n, max(CASE WHEN b.session = e.a THEN b.close END) AS first, max(CASE WHEN b.session = e.z THEN b.close END) AS last FROM (SELECT 1 AS id, DATE '1995-06-01' AS a, DATE '1996-06-01' AS z UNION ALL SELECT 2, DATE '1997-01-01', DATE '1999-01-01') p JOIN $bars b ON b.session >= p.a AND b.session < p.z JOIN (SELECT q.id, c.ticker, min(c.session) AS a, max(c.session) AS z FROM (SELECT 1 AS id, DATE '1995-06-01' AS a, DATE '1996-06-01' AS z UNION ALL SELECT 2, DATE '1997-01-01', DATE '1999-01-01') q JOIN $bars c ON c.session >= q.a AND c.session < q.z GROUP BY q.id, c.ticker) e ON e.id = p.id AND e.ticker = b.ticker GROUP BY p.id, b.ticker) t",
    "g04_group_context": "SELECT g.grp, CAST(f.session AS STRING) AS session, count(*) AS members, round(avg(f.chg_20), 4) AS mean_chg_20, round(avg(CASE WHEN f.close > f.sma50 THEN 1D ELSE 0D END), 6) AS breadth FROM $features f JOIN $groups g ON f.ticker = g.ticker WHERE f.sma50 IS NOT NULL AND f.chg_20 IS NOT NULL GROUP BY g.grp, f.session",
    "g06_risk_comparison": "SELECT fold, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall_ FROM (SELECT year(session) AS fold, sum(CASE WHEN climax AND tail_down THEN 1D ELSE 0D END) AS tp, sum(CASE WHEN climax AND NOT tail_down THEN 1D ELSE 0D END) AS fp, sum(CASE WHEN NOT climax AND tail_down THEN 1D ELSE 0D END) AS fn FROM (SELECT session, tail_down, coalesce(chg_15 >= 0.25 AND vr >= 1.5, false) AS climax FROM $features WHERE tail_down IS NOT NULL) t GROUP BY year(session)) u",
    "x12_remembered_demand": _DEMAND + "SELECT ticker, CAST(session AS STRING) AS session, n, round(strength, 6) AS strength, round(nearest, 6) AS nearest FROM r",
    "x13_demand_confluence": _DEMAND + "SELECT r.ticker, CAST(r.session AS STRING) AS session, CASE WHEN r.nearest IS NULL THEN 'none' WHEN s.support IS NULL OR abs(r.nearest - s.support) > 0.5D * s.atr20 THEN 'demand_only' ELSE 'confluence' END AS support_kind, least(100D, round(20 * r.strength + CASE WHEN abs(r.nearest - s.support) <= 0.5D * s.atr20 THEN 20D ELSE 0D END, 5)) AS score FROM r JOIN (SELECT ticker, session, atr20, min(low) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS support FROM $features) s ON s.ticker = r.ticker AND s.session = r.session WHERE s.atr20 IS NOT NULL",
}


#: Ranks, years and folds are longs in every engine but Spark's own functions.
LONGS = {"year", "k", "phase", "q", "place", "fold"}


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark_sql(spark, sf_dir, text)
        return df.withColumns({c: df[c].cast("long") for c, kind in df.dtypes if kind == "int" and c in LONGS})

    return run


QUERIES = {k: query(v) for k, v in TEXTS.items()}
ORACLE_SQL = {k: duck_sql(v) for k, v in TEXTS.items()}
