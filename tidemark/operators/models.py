"""Statistics and models whose sums are aggregated by Spark and whose small systems are solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import numbered_sessions


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """term, weight of a ridge fit on standardised features (population variance) with a free intercept.

    One aggregation gives counts, sums and products, (k + 2)**2 numbers at any size. Rows with a null are
    left out; a constant feature has weight 0.
    """
    spark = rows.sparkSession
    full = rows.dropna(subset=[*features, target])
    terms = [*features, target]
    aggs = [F.count("*").alias("n")] + [F.sum(t).alias(f"s_{i}") for i, t in enumerate(terms)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    r = full.agg(*aggs).first()
    k, n = len(features), r["n"]
    if not n:
        return spark.createDataFrame([], "term string, weight double")
    mean = np.array([r[f"s_{i}"] for i in range(k + 1)]) / n
    cov = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    use = sd > 1e-12
    z = cov[:k, :k][np.ix_(use, use)] / np.outer(sd[use], sd[use])
    w = np.zeros(k)
    w[use] = np.linalg.solve(z * n + alpha * np.eye(int(use.sum())), cov[:k, k][use] / sd[use] * n)
    return spark.createDataFrame([("intercept", float(mean[k])), *((f, float(x)) for f, x in zip(features, w))], "term string, weight double")


def linear_scores(rows: DataFrame, weights: dict[str, float], intercept: float, means: dict[str, float], deviations: dict[str, float]) -> DataFrame:
    """rows with score: a frozen linear model as one expression."""
    score = F.lit(intercept)
    for f, w in weights.items():
        score = score + (F.coalesce(F.col(f), F.lit(means[f])) - means[f]) / (deviations[f] or 1.0) * w
    return rows.withColumn("score", score)


def block_bootstrap(rows: DataFrame, block: str, value: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """mean, low and high (2.5 and 97.5 percent) of the mean under resampling whole blocks.

    Blocks shrink to sums and counts first; each resample then weights every block by a Poisson(1) draw from
    a seeded hash, so the work is blocks times resamples in one aggregation, with no draws to store.
    """
    sums = rows.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = (F.pmod(F.xxhash64(F.col(block), F.col("b"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cut, total, p = [], 0.0, float(np.exp(-1))
    for k in range(8):
        total += p
        cut.append(total)
        p /= k + 1
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cut), F.lit(0))
    drawn = sums.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    means = drawn.groupBy("b").agg((F.sum(F.col("s") * F.col("w")) / F.greatest(F.sum(F.col("n") * F.col("w")), F.lit(1))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def moving_block_bootstrap(rows: DataFrame, session: str, value: str, length: int = 40, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """mean, low and high of the mean under resampling overlapping blocks of `length` sessions.

    Sessions shrink to sums first, and each block to the sums of its sessions by one window over the calendar; a resample
    draws about sessions / length blocks: each block counts by a Poisson draw of that mean share from a seeded hash.
    """
    sums = rows.groupBy(session).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    placed = sums.join(numbered_sessions(sums, session), session)
    ahead = Window.orderBy("number").rowsBetween(0, length - 1)  # a row a session
    blocks = placed.select("number", F.sum("s").over(ahead).alias("s"), F.sum("n").over(ahead).alias("n"), F.count("*").over(ahead).alias("long")).where(F.col("long") == length)
    u = (F.pmod(F.xxhash64("number", "b", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cut, total, p = [], 0.0, float(np.exp(-1 / length))
    for k in range(6):
        total += p
        cut.append(total)
        p /= length * (k + 1)
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cut), F.lit(0))
    drawn = blocks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight).where("w > 0")
    means = drawn.groupBy("b").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
