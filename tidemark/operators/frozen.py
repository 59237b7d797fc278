"""Frozen linear artifacts: fitted models kept as rows, scored many at a time, and a ledger of what they said before it was known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import ledger_append

#: One row for each version, class and feature. Rows of a version agree in kind, event_threshold and neutral_band; rows of a class in intercept.
ARTIFACT = "version string, kind string, class string, feature string, imputation double, center double, scale double, coefficient double, intercept double, event_threshold double, neutral_band double"
KINDS = ("ridge", "binary_logistic", "direction_logistic")
#: Logits beyond this count as it.
LOGIT_CAP = 35.0
#: Features beyond this count as it, before they are centred.
FEATURE_CAP = 1e12


def checked(artifacts: DataFrame) -> DataFrame:
    """artifacts, or an error: unknown kinds, missing or infinite parameters, scales that aren't positive, classes that don't fit the kind, features given twice."""
    numbers = ["imputation", "center", "scale", "coefficient", "intercept", "event_threshold", "neutral_band"]
    bad = ~F.col("kind").isin(*KINDS) | (F.col("scale") <= 0) | (F.col("neutral_band") < 0) | ~F.col("event_threshold").between(0, 1) | F.col("feature").isNull()
    for c in numbers:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    wrong = artifacts.where(F.coalesce(bad, F.lit(True))).select("version").distinct().limit(3).collect()
    whole = artifacts.groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("class", "feature").alias("cells"), F.count_distinct("kind").alias("kinds"), F.count_distinct("feature").alias("features"), F.array_sort(F.collect_set("class")).alias("classes"), F.first("kind").alias("kind"))
    fits = F.when(F.col("kind") == "direction_logistic", F.concat_ws(",", "classes") == "down,neutral,up").otherwise(F.size("classes") == 1)
    odd = whole.where((F.col("n") != F.col("cells")) | (F.col("kinds") > 1) | (F.col("n") != F.col("features") * F.size("classes")) | ~fits).select("version").limit(3).collect()
    if wrong or odd:
        raise ValueError(f"artifacts that don't hold together: {[r[0] for r in [*wrong, *odd]]}")
    return artifacts


def score(rows: DataFrame, artifacts: DataFrame, keep: list[str], most: int = 1000) -> DataFrame:
    """keep, version, predicted_event, predicted_score, predicted_direction and predicted_return of every version, in one pass over rows.

    Features are columns of rows; a missing or infinite one takes the artifact's value for it. ridge: the score is minus the return, the direction
    by the neutral band. binary_logistic: the probability, an event from the threshold on. direction_logistic: one against the rest,
    shares of the three; the score is that of `down`. Every row meets every version, so their number is checked: more than `most`
    is an error. A feature that rows lack is an error too.
    """
    known = checked(artifacts)
    names = [r[0] for r in known.select("feature").distinct().limit(10_000).collect()]
    if lacking := sorted(set(names) - set(rows.columns)):
        raise ValueError(f"rows lack features: {lacking}")
    if known.select("version").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} versions at once")
    term = F.struct("feature", "imputation", "center", "scale", "coefficient")
    classes = known.groupBy("version", "kind", "class", "intercept", "event_threshold", "neutral_band").agg(F.array_sort(F.collect_list(term)).alias("terms"))
    models = classes.groupBy("version", "kind", "event_threshold", "neutral_band").agg(F.array_sort(F.collect_list(F.struct("class", "intercept", "terms"))).alias("heads"))
    usable = lambda c: F.when(F.abs(c.cast("double")) < float("inf"), F.least(F.greatest(c.cast("double"), F.lit(-FEATURE_CAP)), F.lit(FEATURE_CAP)))
    table = F.create_map(*(x for n in sorted(names) for x in (F.lit(n), usable(F.col(f"`{n}`")))))
    met = rows.select(*(F.col(f"`{c}`") for c in keep), table.alias("__x")).crossJoin(F.broadcast(models))

    def logit(head: Column) -> Column:
        return F.aggregate(head["terms"], head["intercept"], lambda a, t: a + t["coefficient"] * ((F.coalesce(F.element_at(F.col("__x"), t["feature"]), t["imputation"]) - t["center"]) / t["scale"]))

    met = met.withColumn("__l", F.transform("heads", lambda h: F.struct(h["class"].alias("class"), logit(h).alias("v"))))
    sure = lambda v: 1 / (1 + F.exp(-F.least(F.greatest(v, F.lit(-LOGIT_CAP)), F.lit(LOGIT_CAP))))
    met = met.withColumn("__p", F.transform("__l", lambda x: F.struct(sure(x["v"]).alias("p"), x["class"].alias("class"))))
    total = F.aggregate("__p", F.lit(0.0), lambda a, x: a + x["p"])
    down = F.element_at(F.filter("__p", lambda x: x["class"] == "down"), 1)["p"]
    # The first class of greatest share, in order of names.
    best = F.element_at(F.filter("__p", lambda x: x["p"] == F.array_max(F.transform("__p", lambda y: y["p"]))), 1)["class"]
    first, share = F.element_at("__l", 1)["v"], F.element_at("__p", 1)["p"]
    ridge, binary = F.col("kind") == "ridge", F.col("kind") == "binary_logistic"
    direction = F.when(ridge, F.when(first < -F.col("neutral_band"), "down").when(first > F.col("neutral_band"), "up").otherwise("neutral")).when(binary, F.when(share >= F.col("event_threshold"), "down").otherwise("not_down")).otherwise(best)
    value = F.when(ridge, -first).when(binary, share).otherwise(down / total)
    return met.select(*(F.col(f"`{c}`") for c in keep), "version", (direction == "down").alias("predicted_event"), value.alias("predicted_score"), direction.alias("predicted_direction"), F.when(ridge, first).alias("predicted_return"))


LEDGER_KEYS = ["version", "ticker", "observation_date", "horizon"]


def record(ledger: DataFrame, predictions: DataFrame) -> DataFrame:
    """The ledger with new predictions: one known already must say the same."""
    return ledger_append(ledger, predictions, LEDGER_KEYS)


def mature(ledger: DataFrame, outcomes: DataFrame, matured: DataFrame) -> DataFrame:
    """matured with the outcomes of predictions that stand in the ledger; a matured outcome can't change, and one without a prediction is an error.

    outcomes and matured have the keys and what came of them. An outcome observed before its prediction was made can't be told from
    the dates here; the ledger keeps what was appended first.
    """
    orphans = outcomes.join(ledger.select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti").limit(3).collect()
    if orphans:
        raise ValueError(f"outcomes without a prediction: {orphans}")
    return ledger_append(matured, outcomes, LEDGER_KEYS)
