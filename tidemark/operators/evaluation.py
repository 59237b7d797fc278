"""How predictions did: metric rows by any keys, comparisons with a baseline, gates, ablations and paired evidence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import cumulated_within, exact_quantiles


def metric_rows(predictions: DataFrame, by: list[str], minimum: int = 30) -> DataFrame:
    """The keys `by`, the counts left out, and the metrics of each group, with status ok or insufficient.

    predictions: the keys, status, predicted_event, predicted_score, actual_event, mature, terminal_return, mae, mfe and
    lead_sessions. A row counts if its status is available, it is mature, and both events are known. Groups of under
    `minimum` rows or of one kind of outcome only are insufficient and have no metrics. Ranks (roc_auc, and pr_auc as
    average precision) need a finite score on every row and over two different ones; they come from counts by score, ranked over range partitions led by the keys, so no task holds a group.
    """
    on, both = F.lit(True), (F.col("status") == "available") & F.col("predicted_event").isNotNull()
    grown = F.col("mature") & F.col("actual_event").isNotNull()
    rows = predictions.withColumn("__ok", F.coalesce(both & grown, F.lit(False)))
    p, a, ok = F.col("predicted_event"), F.col("actual_event"), F.col("__ok")
    finite = F.col("predicted_score").isNotNull() & ~F.isnan("predicted_score") & (F.abs("predicted_score") < float("inf"))
    mean = lambda c, when=on: F.avg(F.when(ok & when & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
    base = rows.groupBy(*by).agg(
        F.count_if(ok).alias("sample_count"),
        F.count_if(~F.coalesce(both, F.lit(False))).alias("excluded_unavailable_count"),
        F.count_if(~F.coalesce(grown, F.lit(False))).alias("excluded_immature_count"),
        *(F.count_if(ok & (p if x else ~p) & (a if y else ~a)).alias(n) for n, x, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))),
        F.count_if(ok & ~finite).alias("unscored"),
        mean("terminal_return").alias("mean_terminal_return"),
        mean("mae").alias("mean_mae"),
        mean("mfe").alias("mean_mfe"),
        mean("lead_sessions").alias("mean_lead_sessions"),
        mean("mfe", p & ~a).alias("false_positive_opportunity_cost"),
    )
    tied = rows.where("__ok").where(finite).groupBy(*by, "predicted_score").agg(F.count_if(a).alias("pos"), F.count_if(~a).alias("neg"))
    placed = cumulated_within(tied, by, ["predicted_score"], ["pos", "neg"])
    # Those at a score or above it are all but those below.
    ranked = placed.select(*by, "pos", "neg", (F.col("all_pos") - F.col("before_pos")).alias("tp_at"), (F.col("all_neg") - F.col("before_neg")).alias("fp_at"), F.col("all_pos").alias("P"), F.col("all_neg").alias("N"))
    ranks = ranked.groupBy(*by).agg(
        F.count("*").alias("scores"),
        F.try_divide(F.sum(F.col("neg") * (F.col("tp_at") - F.col("pos") / 2)), F.first("P") * F.first("N")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp_at") / (F.col("tp_at") + F.col("fp_at"))), F.first("P")).alias("ap"),
    )
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    f1 = lambda x, y: F.coalesce(F.try_divide(2 * x * y, x + y), F.lit(0.0))
    m = base.join(ranks, by, "left").select(
        "*",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("negative_precision"),
    )
    enough = (F.col("sample_count") >= minimum) & (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    ranked_ok = (F.col("unscored") == 0) & (F.col("scores") > 2)
    shown = {
        "event_rate": F.try_divide(F.col("tp") + F.col("fn"), F.col("sample_count")),
        "signal_rate": F.try_divide(F.col("tp") + F.col("fp"), F.col("sample_count")),
        "precision": F.col("precision"),
        "recall": F.col("recall"),
        "specificity": F.col("specificity"),
        "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2,
        "macro_f1": (f1(F.col("precision"), F.col("recall")) + f1(F.col("negative_precision"), F.col("specificity"))) / 2,
        "false_positive_rate": 1 - F.col("specificity"),
        "roc_auc": F.when(ranked_ok, F.col("auc")),
        "pr_auc": F.when(ranked_ok, F.col("ap")),
        **{c: F.col(c) for c in ("mean_terminal_return", "mean_mae", "mean_mfe", "mean_lead_sessions", "false_positive_opportunity_cost")},
    }
    return m.select(
        *by,
        "sample_count",
        "excluded_unavailable_count",
        "excluded_immature_count",
        F.when(enough, F.col("tp") + F.col("fp")).otherwise(0).alias("signal_count"),
        *(F.when(enough, x).alias(n) for n, x in shown.items()),
        F.when(enough, "ok").otherwise("insufficient").alias("status"),
    )


def compare_folds(metrics: DataFrame, by: list[str], baseline: str, measure: str = "balanced_accuracy") -> DataFrame:
    """by, specification, comparable_fold_count, fold_win_rate and mean_difference against the baseline's row of the same fold.

    metrics: by, fold, specification, status and the measure; only folds in which both are ok compare.
    """
    ok = metrics.where(F.col("status") == "ok").select(*by, "fold", "specification", F.col(measure).alias("m"))
    base = ok.where(F.col("specification") == baseline).select(*by, "fold", F.col("m").alias("b"))
    other = ok.where(F.col("specification") != baseline).join(base, [*by, "fold"])
    return other.groupBy(*by, "specification").agg(F.count("*").alias("comparable_fold_count"), F.avg((F.col("m") > F.col("b")).cast("double")).alias("fold_win_rate"), F.avg(F.col("m") - F.col("b")).alias("mean_difference"))


def promotion_gate(metrics: DataFrame, comparisons: DataFrame, required: list[str], baseline: str, folds: int = 3) -> DataFrame:
    """One row: passed, and the reasons why not. Both frames have sample_mode; only non-overlapping samples count.

    Every required scope needs metrics that are ok, and some specification must win over half of at least `folds` folds.
    """
    clean = F.col("sample_mode") == "non_overlapping"
    seen = metrics.where(clean & (F.col("status") == "ok")).agg(F.collect_set(F.when(F.col("scope").isin(*required), F.col("scope"))).alias("scopes"))
    any_ = comparisons.agg(F.count("*").alias("n"), F.count_if(clean & (F.col("specification") != baseline) & (F.col("comparable_fold_count") >= folds) & (F.col("fold_win_rate") > 0.5)).alias("won"))
    missing = F.when(F.size("scopes") < len(set(required)), "required_group_evidence_missing")
    lost = F.when(F.col("n") == 0, "paired_fold_evidence_missing").when(F.col("won") == 0, "fold_majority_not_won")
    one = seen.crossJoin(any_).select(F.array_compact(F.array(missing, lost)).alias("reasons"))  # a row each
    return one.select((F.size("reasons") == 0).alias("passed"), "reasons")


def ablations(rows: DataFrame, groups: dict[str, list[str]], score) -> DataFrame:
    """rows once for each specification, all and without_<group>, with that group's columns null and `score` of the rest.

    score takes a dict of columns by name and gives a column. All specifications come from one pass over rows.
    """
    specs = [("all", []), *((f"without_{g}", columns) for g, columns in groups.items())]
    every = {c for columns in groups.values() for c in columns}
    made = []
    for name, gone in specs:
        values = {c: F.lit(None).cast(rows.schema[c].dataType) if c in gone else F.col(c) for c in every}
        made.append(F.struct(F.lit(name).alias("specification"), score(values).alias("score")))
    rest = [c for c in rows.columns if c not in every]
    return rows.select(*rest, F.explode(F.array(*made)).alias("__x")).select(*rest, "__x.specification", "__x.score")


def paired_evidence(pairs: DataFrame, features: list[str], by: list[str] | None = None, resamples: int = 2000, block_days: int = 20, minimum: int = 50, effect: float = 0.2, rate: float = 0.10, seed: int = 20260730) -> DataFrame:
    """by, feature and what the paired differences say: means, standardised difference, bootstrap interval and p, FDR, admitted.

    pairs: by, session of the case, and case_x and control_x for each feature x. Differences shrink to sums by blocks of
    block_days days; each resample weighs a block by a Poisson draw of a seeded hash. The p-value is two-sided, at most
    1; its false-discovery rate is over the features of a group. Admitted: at least `minimum` pairs, a standardised
    difference of at least `effect` and a rate of at most `rate`.
    """
    by = by or []
    one = F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), (F.col(f"case_{x}") - F.col(f"control_{x}")).cast("double").alias("d")) for x in features)))
    block = F.floor(F.datediff("session", F.lit("1970-01-01").cast("date")) / block_days)
    rows = pairs.select(*by, block.alias("block"), one.alias("x")).select(*by, "block", "x.feature", "x.d")
    known = rows.where(F.col("d").isNotNull() & ~F.isnan("d"))
    keys = [*by, "feature"]
    whole = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    middle = exact_quantiles(known, ["d"], [0.5], keys).select(*keys, F.col("value").alias("median"))
    sums = known.groupBy(*keys, "block").agg(F.sum("d").alias("s"), F.count("*").alias("m"))
    u = (F.pmod(F.xxhash64("block", "b", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, total, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += p
        weight = weight + F.when(u > total, 1).otherwise(0)
        p /= k + 1
    drawn = sums.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight).where("w > 0")
    means = drawn.groupBy(*keys, "b").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("m") * F.col("w"))).alias("r"))
    tail = means.groupBy(*keys).agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"), F.avg((F.col("r") <= 0).cast("double")).alias("down"), F.avg((F.col("r") >= 0).cast("double")).alias("up"))
    usable = (F.col("n") >= 2) & (F.col("sd") > 0)
    out = whole.join(middle, keys, "left").join(tail, keys, "left").select(*keys, "n", "mean", "median", F.when(usable, F.col("mean") / F.col("sd")).alias("standardised"), F.when(usable, F.col("low")).alias("low"), F.when(usable, F.col("high")).alias("high"), F.when(usable, F.least(F.lit(1.0), 2 * F.least("down", "up"))).alias("p"))
    # A row a feature: Benjamini-Hochberg by rank, made monotone from the greatest p down.
    tested = Window.partitionBy(*by, F.col("p").isNull())
    rank = F.row_number().over(tested.orderBy("p", "feature"))
    raw = out.withColumn("__q", F.when(F.col("p").isNotNull(), F.col("p") * F.count("p").over(tested) / rank))
    q = F.min("__q").over(tested.orderBy(F.desc("p"), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0))
    out = raw.withColumn("q", F.least(F.lit(1.0), q)).drop("__q")
    admitted = (F.col("n") >= minimum) & (F.abs("standardised") >= effect) & (F.col("q") <= rate)
    return out.withColumn("admitted", F.coalesce(admitted, F.lit(False)))


def transition_outcomes(rows: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """ticker, session, was, state, and fwd_h, mae_h and mfe_h of each session at which a ticker's state changed to a known one.

    rows: ticker, session, open, high, low, close and state. Entry is the next open; an outcome needs its whole path and an
    entry above 0. The first session of a ticker is no change.
    """
    order = Window.partitionBy("ticker").orderBy("session")
    out, entry = rows.withColumn("was", F.lag("state").over(order)), F.lead("open").over(order)
    for h in horizons:
        path = order.rowsBetween(1, h)
        whole = (F.count("low").over(path) == h) & (F.count("high").over(path) == h) & (entry > 0)
        ends = {"fwd": F.lead("close", h).over(order), "mae": F.min("low").over(path), "mfe": F.max("high").over(path)}
        out = out.withColumns({f"{k}_{h}": F.when(whole, x / entry - 1) for k, x in ends.items()})
    changed = out.where((F.col("was") != F.col("state")) & (F.col("state") != "unavailable"))
    return changed.select("ticker", "session", "was", "state", *(f"{k}_{h}" for h in horizons for k in ("fwd", "mae", "mfe")))
