"""Trade and quote streams: the same transforms serve batch frames and Structured Streaming.

Columns: symbol, event_id, event_ts, ns (exact time in nanoseconds), kind, price, size. What needs all events
again (corrections) is a batch recomputation; what a watermark bounds (bars, duplicates) also streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import lasts_before
from tidemark.sources.storage import cut

#: Nanoseconds of a day.
DAY = 86_400_000_000_000


def normalise(raw: DataFrame) -> DataFrame:
    """JSON messages (column value) to typed events; control messages and invalid ones keep a reason and no price."""
    # A map keeps `S` and `s` apart, which a struct's field names would not.
    m = F.from_json("value", "map<string, string>")
    text = lambda k: F.col("m")[k]
    number = lambda k: F.expr(f"try_cast(m['{k}'] AS double)")
    e = raw.select(m.alias("m"))
    kind = F.when(text("T") == "q", "quote").when(text("T") == "t", "trade").when(text("T") == "c", "correction").when(text("T") == "x", "cancel").otherwise("control")
    fraction = F.rpad(F.regexp_extract(text("t"), r"\.(\d{1,9})", 1), 9, "0")
    at = F.try_to_timestamp(F.regexp_replace(text("t"), r"\.\d+", ""))
    ns = F.unix_timestamp(at) * 1_000_000_000 + fraction.cast("long")
    bid, ask = number("bp"), number("ap")
    crossed = F.coalesce((bid > ask) | (bid <= 0), F.lit(True))
    reason = F.when(kind == "control", "control").when(at.isNull(), "invalid_time").when((kind == "quote") & crossed, "invalid_quote").when((kind == "trade") & (F.coalesce(number("p"), F.lit(0.0)) <= 0), "invalid_trade")
    return e.select(
        F.upper(F.trim(text("S"))).alias("symbol"),
        F.expr("try_cast(m['i'] AS long)").alias("event_id"),
        F.try_to_timestamp(text("t")).alias("event_ts"),
        ns.alias("ns"),
        kind.alias("kind"),
        F.when(kind == "quote", (bid + ask) / 2).otherwise(number("p")).alias("price"),
        F.when(kind == "quote", (number("bs") + number("as")) * 100).otherwise(number("s")).alias("size"),
        reason.alias("reason"),
    )


def directions(events: DataFrame, max_age_ns: int = 5_000_000_000) -> DataFrame:
    """Each trade as buy, sell or unknown: against the last quote if young enough, else by the tick before.

    Quotes and trades go through one window, quotes of an instant before its trades; a task sorts a symbol's day.
    """
    quote = F.col("kind") == "quote"
    rows = events.where("kind IN ('trade', 'quote')").select("symbol", "ns", F.when(quote, 0).otherwise(1).alias("__side"), "event_id", "price", "size")
    quoted = {"__quote": F.when(F.col("__side") == 0, F.struct("price", "ns")), "before": F.when(F.col("__side") == 1, F.col("price"))}
    joined = lasts_before(rows, ["symbol"], "ns", ["ns", "__side", "event_id"], quoted, DAY).where("__side = 1")
    joined = joined.withColumn("mid", F.when(F.col("ns") - F.col("__quote.ns") <= max_age_ns, F.col("__quote.price")))
    before = F.col("before")
    side = F.when(F.col("mid").isNotNull() & (F.col("price") > F.col("mid")), "buy").when(F.col("mid").isNotNull() & (F.col("price") < F.col("mid")), "sell")
    side = side.when(F.col("price") > before, "buy").when(F.col("price") < before, "sell").otherwise("unknown")
    how = F.when(F.col("mid").isNotNull() & (F.col("price") != F.col("mid")), "quote_mid").when(before.isNotNull() & (F.col("price") != before), "tick_rule").otherwise("none")
    return joined.select("symbol", "ns", "event_id", "price", "size", side.alias("direction"), how.alias("method"))


def effective(trades: DataFrame, changes: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades after corrections and cancels. changes: the columns `by`, old_id, new_id (null for a cancel), price.

    Ids count inside their `by` (provider and symbol, say), so one symbol's cancel leaves another's trades alone. Of
    several changes of one id the one with the greatest new_id counts. Chains are followed by doubling, a few equi-joins
    a round, until all have ended. What goes on for more hops than there are changes loops. A chain that meets a cancel
    drops its trade, and so does one that loops, for it has no last price.
    """
    by = list(by)
    latest = F.max_by(F.struct("new_id", "price"), F.struct(F.coalesce("new_id", F.lit(-1)), "price"))
    link = changes.where("old_id IS NOT NULL").groupBy(*by, "old_id").agg(latest.alias("c")).select(*by, "old_id", F.col("c.new_id").alias("new_id"), F.col("c.price").alias("new_price"))
    # live: the id that the link leads to may have a change of its own.
    link = cut(link.withColumn("gone", F.col("new_id").isNull()).withColumn("live", F.col("new_id").isNotNull()))
    n, hops = link.count(), 1
    while hops <= n and not link.where("live").isEmpty():
        nxt = link.select(*by, F.col("old_id").alias("new_id"), F.col("new_id").alias("n2"), F.col("new_price").alias("p2"), F.col("gone").alias("g2"), F.col("live").alias("l2"))
        step, met = link.join(nxt, [*by, "new_id"], "left"), F.col("g2").isNotNull()
        link = cut(  # each round reads the links twice; a written table keeps the plan from doubling
            step.select(
                *by,
                "old_id",
                F.when(met, F.col("n2")).otherwise(F.col("new_id")).alias("new_id"),
                F.when(met, F.col("p2")).otherwise(F.col("new_price")).alias("new_price"),
                (F.col("gone") | F.coalesce("g2", F.lit(False))).alias("gone"),
                (~F.col("gone") & F.coalesce("l2", F.lit(False))).alias("live"),
            )
        )
        hops *= 2
    out = trades.join(link.withColumnRenamed("old_id", "event_id"), [*by, "event_id"], "left")
    rest = [c for c in by if c != "symbol"]
    return out.where("NOT coalesce(gone OR live, false)").select("symbol", *rest, "ns", "event_ts", "event_id", F.coalesce("new_price", "price").alias("price"), "size", F.col("new_id").alias("replaced_by"))


def minute_bars(trades: DataFrame, watermark: str | None = None) -> DataFrame:
    """One-minute bars by event time; with a watermark the same plan streams in append mode."""
    rows = trades.withWatermark("event_ts", watermark) if watermark else trades
    return rows.groupBy("symbol", F.window("event_ts", "1 minute").alias("w")).agg(
        F.min_by("price", F.struct("ns", "event_id")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ns", "event_id")).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("trades"),
    ).select("symbol", F.col("w.start").alias("minute"), "open", "high", "low", "close", "volume", "trades")


def trailing(directed: DataFrame, minutes: int) -> DataFrame:
    """A row for each symbol: its trades of the last minutes (1 to 390) up to its newest one, on that one's day only.

    directed: as directions() gives them, with ns and event_id. Volumes by direction, their delta, the pressure 100 * (buy - sell) / (buy + sell), and the
    share of the volume that has a direction. Sums and ends are added up before they are shuffled, so a busy symbol is no long group.
    """
    if not 1 <= minutes <= 390:
        raise ValueError("minutes must be from 1 to 390")
    newest = directed.groupBy("symbol").agg(F.max("ns").alias("__newest"))
    rows = directed.join(newest, "symbol").where((F.col("ns") >= F.col("__newest") - minutes * 60_000_000_000) & (F.floor(F.col("ns") / DAY) == F.floor(F.col("__newest") / DAY)))
    at = F.struct("ns", "event_id")
    side = lambda name: F.sum(F.when(F.col("direction") == name, F.col("size").cast("double")).otherwise(0.0))
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(F.col("size").cast("double")).alias("volume"), side("buy").alias("buy_volume"), side("sell").alias("sell_volume"), side("unknown").alias("unknown_volume"),
    )
    both = F.col("buy_volume") + F.col("sell_volume")
    return out.select("*", (F.col("buy_volume") - F.col("sell_volume")).alias("delta"), (100 * F.try_divide(F.col("buy_volume") - F.col("sell_volume"), both)).alias("pressure"), F.try_divide(both, F.col("volume")).alias("coverage"))


def event_key(by: tuple[str, ...] = ("symbol",)) -> Column:
    """What makes an event the same inside its kind and `by`: its id, or without one a hash of its fields and its exact time."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*by, "kind", "ns", "price", "size")]
    return F.coalesce(F.concat(F.lit("id:"), F.col("event_id").cast("string")), F.concat(F.lit("hash:"), F.sha2(F.concat_ws("|", *fields), 256)))


def deduplicated(events: DataFrame, watermark: str = "10 minutes", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One of each (by, kind, event_key); the state of a stream is bounded by the watermark.

    A source numbers its trades, quotes, corrections and cancels apart, so a trade and a quote of one id both stay. by: what
    ids count inside, such as provider and symbol. Nulls in `by` or kind are equal to each other.
    """
    keyed = events.withColumn("__key", event_key(by))
    keys = [*by, "kind", "__key"]
    if events.isStreaming:
        return keyed.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(keys).drop("__key")
    return keyed.dropDuplicates(keys).drop("__key")


def stream_directions(events: DataFrame, max_age_ns: int = 5_000_000_000) -> DataFrame:
    """directions() on a stream: state by symbol is the last quote and the last trade; late trades get no tick rule."""
    schema = "symbol long, ns long, event_id long, price double, size double, direction string, method string"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        q_ns, q_mid, t_ns, t_price = state.get if state.exists else (-1, None, -1, None)
        rows = []
        for pdf in frames:
            for r in pdf.sort_values(["ns", "kind", "event_id"]).itertuples():
                if r.kind == "quote":
                    if r.ns >= q_ns:
                        q_ns, q_mid = int(r.ns), float(r.price)
                    continue
                if r.kind != "trade":
                    continue
                side, how = "unknown", "none"
                if q_mid is not None and 0 <= r.ns - q_ns <= max_age_ns and r.price != q_mid:
                    side, how = ("buy" if r.price > q_mid else "sell"), "quote_mid"
                elif t_price is not None and r.ns >= t_ns and r.price != t_price:
                    side, how = ("buy" if r.price > t_price else "sell"), "tick_rule"
                if r.ns >= t_ns:
                    t_ns, t_price = int(r.ns), float(r.price)
                rows.append((key[0], r.ns, r.event_id, r.price, r.size, side, how))
        state.update((q_ns, q_mid, t_ns, t_price))
        yield pd.DataFrame(rows, columns=["symbol", "ns", "event_id", "price", "size", "direction", "method"])

    return events.groupBy("symbol").applyInPandasWithState(run, schema, "q_ns long, q_mid double, t_ns long, t_price double", "append", "NoTimeout")
