"""As-of and interval joins without range joins: one shuffle by key, one ordered window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, by: list[str], time: str, order: list[str], value: Column, name: str, span: int, include: bool = False) -> DataFrame:
    """df with `name`: the last value that is not null in the rows before (with include, up to the row itself), along each key."""
    return lasts_before(df, by, time, order, {name: value}, span, include)


def lasts_before(df: DataFrame, by: list[str], time: str, order: list[str], values: dict[str, Column], span: int, include: bool = False) -> DataFrame:
    """df with a column for each of values: the last one that is not null in the rows before (with include, up to the row itself), along each key.

    time is an integer and leads `order`. Time is cut into spans, so a busy key is many groups: one window inside each span for all
    values, and the last values of each span carried over the spans after it, of which there is one row for each key and span.
    """
    names = list(values)
    cut = df.withColumn("__span", F.floor(F.col(time) / span)).withColumns({f"__v{i}": values[n] for i, n in enumerate(names)})
    inside = Window.partitionBy(*by, "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    at = F.struct(*order)
    known = [F.col(f"__v{i}").isNotNull() for i in range(len(names))]
    spans = cut.groupBy(*by, "__span").agg(*(F.max_by(F.struct(f"__v{i}"), F.when(k, at)).alias(f"__l{i}") for i, k in enumerate(known)))
    earlier = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*by, "__span", *(F.last(f"__l{i}", ignorenulls=True).over(earlier).alias(f"__c{i}") for i in range(len(names))))
    out = cut.select("*", *(F.last(F.when(k, F.struct(f"__v{i}")), ignorenulls=True).over(inside).alias(f"__n{i}") for i, k in enumerate(known)))
    same = F.col("c.__span") == F.col("s.__span")
    for k in by:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = out.alias("c").join(spans.alias("s"), same, "left")
    return joined.select(*(F.col(f"c.{c}") for c in df.columns), *(F.coalesce(F.col(f"c.__n{i}"), F.col(f"s.__c{i}"))[f"__v{i}"].alias(n) for i, n in enumerate(names)))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], max_age: int | None = None, span: int | None = None) -> DataFrame:
    """left with the right side's values (and `found_at`) of the last row at or before each row's time.

    Both sides are stacked and sorted once; the last right row is carried forward. Right rows of a time
    come before left rows of the same time. max_age: older values are not taken (in units of time, an
    integer). Left rows without a match keep nulls. span: where a key may be busy, the units of time that one task sorts.
    """
    payload = F.struct(F.col(time).alias("found_at"), *values)
    left_cols = [c for c in left.columns if c not in by and c != time]
    a = right.select(*by, time, F.lit(0).alias("__side"), payload.alias("__right"), F.lit(None).cast(left.select(F.struct(*left_cols)).schema[0].dataType if left_cols else "string").alias("__left"))
    b = left.select(*by, time, F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__right"].dataType).alias("__right"), (F.struct(*left_cols) if left_cols else F.lit(None).cast("string")).alias("__left"))
    both = a.unionByName(b)
    if span is None:
        w = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("__found", F.last("__right", ignorenulls=True).over(w))
    else:
        out = last_before(both, by, time, [time, "__side"], F.col("__right"), "__found", span, include=True)
    out = out.where("__side = 1")
    if max_age is not None:
        out = out.withColumn("__found", F.when(F.col(time) - F.col("__found.found_at") <= max_age, F.col("__found")))
    return out.select(*by, time, *(F.col(f"__left.{c}").alias(c) for c in left_cols), F.col("__found.found_at").alias("found_at"), *(F.col(f"__found.{v}").alias(v) for v in values))


def latest_visible(vintages: DataFrame, by: list[str], known: str, cutoff) -> DataFrame:
    """Of bitemporal observations, the newest vintage of each that was known at the cutoff."""
    seen = vintages.where(F.col(known) <= cutoff)
    rest = [c for c in vintages.columns if c not in by]
    best = seen.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(known, *[c for c in rest if c != known])).alias("v"))
    return best.select(*by, *(F.col(f"v.{c}").alias(c) for c in rest))
