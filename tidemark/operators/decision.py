"""The final decision on a forecast: an ordered ladder of immediate, confirmed, joint and persistent risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Thresholds of the ladder; the defaults are fixed values."""

    watch: float = 20.0
    high: float = 30.0
    immediate: float = 70.0
    joint: float = 40.0
    group_watch: float = 40.0
    group_high: float = 60.0
    slow_watch: float = 50.0
    slow_high: float = 70.0

    def __post_init__(self):
        for low, top in ((self.watch, self.high), (self.group_watch, self.group_high), (self.slow_watch, self.slow_high), (self.joint, self.immediate)):
            if not 0 <= low < top <= 100:
                raise ValueError(f"thresholds out of order: {low}, {top}")


def persistent_level(policy: Policy) -> Column:
    """unavailable, low, watch or high: by the sources that have a score, or where none has one by the whole score."""
    sources = (("individual_score", policy.watch, policy.high), ("group_score", policy.group_watch, policy.group_high), ("slow_decline_score", policy.slow_watch, policy.slow_high))
    none, high, watch = F.lit(True), F.lit(False), F.lit(False)
    for c, low, top in sources:
        none = none & F.col(c).isNull()
        high = high | F.coalesce(F.col(c) >= top, F.lit(False))
        watch = watch | F.coalesce(F.col(c) >= low, F.lit(False))
    by_score = F.when(F.col("score") >= policy.high, "high").when(F.col("score") >= policy.watch, "watch").otherwise("low")
    return F.when(~F.col("known"), "unavailable").when(none, by_score).when(high, "high").when(watch, "watch").otherwise("low")


def decide(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """rows with risk_state, final_direction, action and reasons.

    rows: raw_direction (up, neutral, down or unavailable), immediate_score, known (whether there is a persistent risk context), and of that
    individual_score, group_score, slow_decline_score, score, top_state, top_raw_state and sources (names). The first step that holds
    decides: an immediate score at its threshold, a confirmed top, a high persistent level with the joint immediate score (all three
    turn the forecast down), a high persistent level, a high top (these two take back an `up`), a watch. Steps of watch and above name the
    context's sources as well. An unavailable forecast is left as it is: its state is null and its action `retain`.
    """
    level = persistent_level(policy)
    known = F.coalesce(F.col("known"), F.lit(False))
    read = rows.withColumn("known", known).withColumn("__level", level)
    top, raw = F.when(F.col("known"), F.col("top_state")).otherwise("unavailable"), F.when(F.col("known"), F.col("top_raw_state")).otherwise("unavailable")
    sure = lambda c: F.coalesce(c, F.lit(False))
    #: test, state, what becomes of the direction, reasons
    ladder = (
        (sure(F.col("immediate_score") >= policy.immediate), "confirmed", "down", ["immediate_bearish_confirmation"]),
        (sure((top == "confirmed") & (raw == "confirmed")), "confirmed", "down", ["high_level_distribution_risk", "high_level_structure_damage_confirmation"]),
        (sure((F.col("__level") == "high") & (F.col("immediate_score") >= policy.joint)), "confirmed", "down", ["persistent_bearish_risk", "persistent_immediate_confluence"]),
        (F.col("__level") == "high", "high", "neutral", ["persistent_bearish_risk"]),
        (sure(top.isin("high", "fading", "confirmed")), "high", "neutral", ["high_level_distribution_risk"]),
        (F.col("__level") == "watch", "watch", None, ["persistent_bearish_risk"]),
    )
    direction = F.col("raw_direction")
    state, final, reasons = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), F.array(F.lit("")))
    for test, name, turn, why in ladder:
        state = state.when(test, name)
        final = final.when(test, F.lit("down") if turn == "down" else F.when(direction == "up", "neutral").otherwise(direction) if turn else direction)
        reasons = reasons.when(test, F.array(*map(F.lit, why)))
    out = read.withColumn("risk_state", state.otherwise(F.when(F.col("known"), "low").otherwise("unavailable"))).withColumn("final_direction", final.otherwise(direction))
    out = out.withColumn("reasons", reasons.otherwise(F.expr("CAST(array() AS array<string>)")))
    more = F.transform(F.coalesce("sources", F.expr("CAST(array() AS array<string>)")), lambda s: F.concat(s, F.lit("_bearish_risk")))
    out = out.withColumn("reasons", F.when(F.col("known") & F.col("risk_state").isin("watch", "high", "confirmed"), F.concat("reasons", more)).otherwise(F.col("reasons")))
    action = F.when(F.col("final_direction") == direction, "retain").when(F.col("final_direction") == "neutral", "downgrade_to_neutral").otherwise("override_to_down")
    off = direction == "unavailable"
    out = out.withColumn("action", F.when(off, "retain").otherwise(action)).withColumn("final_direction", F.when(off, direction).otherwise(F.col("final_direction")))
    out = out.withColumn("risk_state", F.when(~off, F.col("risk_state"))).withColumn("reasons", F.when(off, F.expr("CAST(array() AS array<string>)")).otherwise(F.col("reasons")))
    return out.drop("__level")
