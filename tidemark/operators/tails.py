"""Quantile heads fitted by sums that Spark adds up, and the tail boundary chosen by what it would have earned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import cut


def pinball(y: Column, prediction: Column, share: Column) -> Column:
    """The loss whose mean is least at the quantile of that share."""
    return F.greatest(share * (y - prediction), (share - 1) * (y - prediction))


def quantile_heads(rows: DataFrame, features: list[str], target: str, shares: list[float], by: list[str] | None = None, rounds: int = 50, tolerance: float = 1e-5) -> DataFrame:
    """by, share, term (intercept or a feature) and weight of linear quantile regressions, one for each share in each group of `by`.

    Each round majorises the pinball loss at the present residuals and solves the weighted least squares that come of it (Hunter
    and Lange's method), so a round is one aggregation of (features + 1)^2 / 2 sums for each group and share, at any number of rows,
    and the loss falls with each. It ends when no weight moves by more than `tolerance` of the target's deviation, or after `rounds`.
    Rows with a null or NaN are left out. Groups are few (folds, horizons): their weights, (features + 1) numbers each, are solved
    on the driver and sent to every task. A feature that is constant in a group has weight 0; a group without rows has none.
    """
    spark, by = rows.sparkSession, by or []
    full = rows.select(*by, *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(f"`{target}`").cast("double").alias("y"))
    names = [*(f"x{i}" for i in range(len(features))), "y"]
    full = cut(full.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names)))
    scale = full.groupBy(*by).agg(F.count("*").alias("n"), *(f(c).alias(f"{m}_{c}") for c in names for m, f in (("m", F.avg), ("s", F.stddev_pop)))).where("n > 0").collect()  # a row a group
    if not scale:
        return spark.createDataFrame([], ", ".join([*(f"`{k}` {full.schema[k].dataType.simpleString()}" for k in by), "share double, term string, weight double"]))
    k = len(features)
    groups = [tuple(r[c] for c in by) for r in scale]
    mean = np.array([[r[f"m_{c}"] for c in names] for r in scale])
    deviation = np.array([[r[f"s_{c}"] for c in names] for r in scale])
    use = deviation[:, :k] > 1e-12
    safe = np.where(use, deviation[:, :k], 1.0)
    unit = np.where(deviation[:, k] > 0, deviation[:, k], 1.0)
    beta = np.zeros((len(groups), len(shares), k + 1))
    kinds = ", ".join([*(f"`{c}` {full.schema[c].dataType.simpleString()}" for c in by), "g int, i int, share double, b array<double>, m array<double>, s array<double>, u double"])

    z = [F.lit(1.0), *((F.col(f"x{j}") - F.col("m")[j]) / F.col("s")[j] for j in range(k))]
    y = (F.col("y") - F.col("m")[k]) / F.col("u")
    guess = z[0] * F.col("b")[0]
    for j in range(k):
        guess = guess + z[j + 1] * F.col("b")[j + 1]
    placed = [f"z{j}" for j in range(k + 1)]
    for _ in range(rounds):
        table = [(*groups[g], g, i, shares[i], beta[g, i].tolist(), mean[g].tolist(), safe[g].tolist(), float(unit[g])) for g in range(len(groups)) for i in range(len(shares))]
        now = F.broadcast(spark.createDataFrame(table, kinds))  # groups x shares rows
        met = full.join(now, by) if by else full.crossJoin(now)
        met = met.select("g", "i", *(x.alias(n) for x, n in zip(z, placed)), y.alias("t"), F.abs(y - guess).alias("r"))
        w = 1 / (F.col("r") + 1e-4)
        pairs = [(a, b) for a in range(k + 1) for b in range(a, k + 1)]
        sums = met.withColumn("w", w).groupBy("g", "i").agg(
            *(F.sum(F.col("w") * F.col(placed[a]) * F.col(placed[b])).alias(f"p{a}_{b}") for a, b in pairs),
            *(F.sum(F.col("w") * F.col(placed[a]) * F.col("t")).alias(f"q{a}") for a in range(k + 1)),
            *(F.sum(placed[a]).alias(f"o{a}") for a in range(k + 1)),
        )
        moved = 0.0
        for r in sums.collect():  # a row a group and share
            g, i = r["g"], r["i"]
            on = np.concatenate([[True], use[g]])
            m = np.array([[r[f"p{min(a, b)}_{max(a, b)}"] for b in range(k + 1)] for a in range(k + 1)])[np.ix_(on, on)]
            v = np.array([r[f"q{a}"] + (2 * shares[i] - 1) * r[f"o{a}"] for a in range(k + 1)])[on]
            fresh = np.zeros(k + 1)
            fresh[on] = np.linalg.lstsq(m, v, rcond=None)[0]
            moved = max(moved, float(np.abs(fresh - beta[g, i]).max()))
            beta[g, i] = fresh
        if moved <= tolerance:
            break
    out = []
    for g, group in enumerate(groups):
        for i, share in enumerate(shares):
            slopes = np.where(use[g], beta[g, i, 1:] / safe[g], 0.0) * unit[g]
            start = mean[g, k] + beta[g, i, 0] * unit[g] - float((slopes * mean[g, :k]).sum())
            out += [(*group, float(share), term, float(x)) for term, x in (("intercept", start), *zip(features, slopes))]
    return spark.createDataFrame(out, ", ".join([*(f"`{c}` {full.schema[c].dataType.simpleString()}" for c in by), "share double, term string, weight double"]))


def quantile_predictions(rows: DataFrame, heads: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with `quantiles`: an array of (share, value), values put in ascending order, so that no quantile crosses a higher one.

    Sorting the values of a row is the monotone rearrangement, which never has a greater loss. Rows with a null feature have a null.
    """
    by = by or []
    wide = heads.groupBy(*by, "share").agg(*(F.sum(F.when(F.col("term") == t, F.col("weight"))).alias(f"w{i}") for i, t in enumerate(["intercept", *features])))
    packed = wide.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("share", F.array(*(f"w{i}" for i in range(len(features) + 1))).alias("w")))).alias("__heads"))  # as many as shares
    packed = F.broadcast(packed)
    met = rows.join(packed, by, "left") if by else rows.crossJoin(packed)

    def value(head: Column) -> Column:
        total = head["w"][0]
        for j, c in enumerate(features):
            total = total + head["w"][j + 1] * F.col(f"`{c}`").cast("double")
        return total

    known = F.lit(True)
    for c in features:
        known = known & F.col(f"`{c}`").isNotNull()
    values = F.array_sort(F.transform("__heads", value))
    paired = F.zip_with(F.transform("__heads", lambda h: h["share"]), values, lambda s, v: F.struct(s.alias("share"), v.alias("value")))
    return met.withColumn("quantiles", F.when(known, paired)).drop("__heads")


def tail_boundary(rows: DataFrame, downs: tuple[float, ...] = (0.4, 0.5, 0.6), rebounds: tuple[float, ...] = (0.2, 0.3), minimum: int = 500, least: float = 0.05, most: float = 0.3, by: list[str] | None = None) -> DataFrame:
    """by, down_threshold, rebound_cap and what the rows beyond that boundary did; status, reasons and chosen.

    rows: down_probability, median_return, lower_return, rebound_probability, down_event (0 or 1) and terminal_return; a row with one
    missing, not finite or another event does not count. Risk rows have at least the threshold, a median below 0, a lower quantile at
    -0.05 or less and at most the cap. A boundary is rejected for fewer than `minimum` risk rows, a share of all rows outside
    [least, most], or a mean return that isn't negative. Chosen is the eligible one of greatest precision, then threshold,
    then least cap; none may be. All boundaries come from one pass; their number is the grid's.
    """
    by = by or []
    fields = ("down_probability", "median_return", "lower_return", "rebound_probability", "down_event", "terminal_return")
    ok = F.lit(True)
    for c in fields:
        ok = ok & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    sound = rows.where(ok & F.col("down_event").cast("double").isin(0.0, 1.0))
    grid = F.explode(F.array(*(F.struct(F.lit(float(d)).alias("down_threshold"), F.lit(float(r)).alias("rebound_cap")) for d in downs for r in rebounds)))
    met = sound.select(*by, *(F.col(c).cast("double").alias(c) for c in fields), grid.alias("b"))
    risk = (F.col("down_probability") >= F.col("b.down_threshold")) & (F.col("median_return") < 0) & (F.col("lower_return") <= -0.05) & (F.col("rebound_probability") <= F.col("b.rebound_cap"))
    found = met.groupBy(*by, "b.down_threshold", "b.rebound_cap").agg(F.count("*").alias("n"), F.count_if(risk).alias("risk_count"), F.avg(F.when(risk, F.col("down_event"))).alias("down_precision"), F.avg(F.when(risk, F.col("terminal_return"))).alias("mean_terminal_return"))
    found = found.withColumn("coverage", F.col("risk_count") / F.col("n"))
    why = F.array_compact(
        F.array(
            F.when(F.col("risk_count") < minimum, "insufficient_risk_rows"),
            F.when(F.col("coverage") < least, "insufficient_risk_coverage"),
            F.when(F.col("coverage") > most, "excessive_risk_coverage"),
            F.when(F.coalesce(F.col("mean_terminal_return") >= 0, F.lit(True)), "non_negative_risk_return"),
        )
    )
    judged = found.withColumn("reasons", why).withColumn("status", F.when(F.size("reasons") == 0, "eligible").otherwise("rejected"))
    best = judged.where("status = 'eligible'").groupBy(*by).agg(F.max_by(F.struct("down_threshold", "rebound_cap"), F.struct("down_precision", "down_threshold", -F.col("rebound_cap"))).alias("__best"))
    met = judged.join(F.broadcast(best), by, "left") if by else judged.join(F.broadcast(best), F.lit(True), "left")  # a row a group
    chosen = F.coalesce((F.col("down_threshold") == F.col("__best.down_threshold")) & (F.col("rebound_cap") == F.col("__best.rebound_cap")), F.lit(False))
    return met.select(*by, "down_threshold", "rebound_cap", "n", "risk_count", "coverage", "down_precision", "mean_terminal_return", "status", "reasons", chosen.alias("chosen"))
