"""Bars, index bars, memberships, vintages and market events from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """ticker, session, open, high, low, close, volume: a part's brand is the ticker, a line item a trade.

    One hash aggregation by (ticker, session); the first and last trade go by order, line and price, which
    is a total order up to equal prices. The part table is joined by key; Spark broadcasts it while small.
    """
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", price)
    day = F.to_date(F.date_trunc(grain, F.col("l_shipdate")))
    trades = lines.join(parts.select("p_partkey", F.col("p_brand").alias("ticker")), lines.l_partkey == F.col("p_partkey"))
    return trades.groupBy("ticker", day.alias("session")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def bars_sql(grain: str = "week") -> str:
    return f"""
SELECT p_brand AS ticker, date_trunc('{grain}', l_shipdate)::DATE AS session,
  arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS close, sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def index_bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """One pooled index over all tickers: the benchmark."""
    lines = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", price)
    return lines.groupBy(F.to_date(F.date_trunc(grain, F.col("l_shipdate"))).alias("session")).agg(
        F.min_by(price, key).alias("m_open"), F.max(price).alias("m_high"), F.min(price).alias("m_low"), F.max_by(price, key).alias("m_close"), F.sum("l_quantity").alias("m_volume")
    )


def index_bars_sql(grain: str = "week") -> str:
    return f"""
SELECT date_trunc('{grain}', l_shipdate)::DATE AS session,
  arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS m_open,
  max(l_extendedprice / l_quantity) AS m_high, min(l_extendedprice / l_quantity) AS m_low,
  arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS m_close, sum(l_quantity) AS m_volume
FROM lineitem GROUP BY 1"""


def group_bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """ticker, session and g_close: the close of the pooled bars of the ticker's group."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = lines.join(parts.select("p_partkey", F.substring("p_brand", 7, 1).alias("grp")), lines.l_partkey == F.col("p_partkey"))
    pooled = trades.groupBy("grp", F.to_date(F.date_trunc(grain, F.col("l_shipdate"))).alias("session")).agg(F.max_by(price, F.struct("l_orderkey", "l_linenumber", price)).alias("g_close"))
    return pooled.join(groups(spark, sf_dir), "grp").select("ticker", "session", "g_close")


def group_bars_sql(grain: str = "week") -> str:
    return f"""
SELECT g.ticker, p.session, p.g_close FROM (
  SELECT substring(p_brand, 7, 1) AS grp, date_trunc('{grain}', l_shipdate)::DATE AS session, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS g_close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
) p JOIN ({GROUPS_SQL}) g ON p.grp = g.grp"""


def emas_sql(grain: str = "week", spans: tuple[int, ...] = (10, 20, 50)) -> str:
    """ticker, session and exponential means, each folded over the list of closes so far."""
    folds = ", ".join(f"list_reduce(c, lambda e, x: e + (x - e) * {2 / (n + 1)!r}::DOUBLE) AS ema{n}" for n in spans)
    return f"SELECT ticker, session, {folds} FROM (SELECT ticker, session, list(close) OVER (PARTITION BY ticker ORDER BY session ROWS UNBOUNDED PRECEDING) AS c FROM ({bars_sql(grain)}))"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker and its group: the manufacturer digit of the brand."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.substring("p_brand", 7, 1).alias("grp")).distinct()


GROUPS_SQL = "SELECT DISTINCT p_brand AS ticker, substring(p_brand, 7, 1) AS grp FROM part"


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, quotes, corrections and cancels from the event table; ns is the exact time in nanoseconds.

    purchase and click are trades, view is a quote around its value, signup corrects and error cancels the
    user's trade before it.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("symbol"),
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"),
        F.when(F.col("event_type").isin("purchase", "click"), "trade").when(F.col("event_type") == "view", "quote").when(F.col("event_type") == "signup", "correction").otherwise("cancel").alias("kind"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"),
    )


MARKET_EVENTS_SQL = """
SELECT user_id AS symbol, event_id, ts AS event_ts, epoch_us(ts) * 1000 AS ns,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'trade' WHEN event_type = 'view' THEN 'quote' WHEN event_type = 'signup' THEN 'correction' ELSE 'cancel' END AS kind,
  value AS price, (props::JSON ->> '$.k')::BIGINT + 1 AS size
FROM events"""
