"""Which register entry a delisted ticker was: evidence by name, ISIN and type, decided conservatively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types that do not speak against a common stock.
COMMON = ("common stock", "common equity")


def plain_name(name):
    """Upper case, letters and digits only, parted by one space."""
    return F.trim(F.regexp_replace(F.upper(name), r"[^A-Z0-9]+", " "))


def name_candidates(sample: DataFrame, register: DataFrame) -> DataFrame:
    """ticker, cik, by_current, by_former, by_ticker, former_from and former_to: register entries that share a name or the ticker.

    sample: ticker, name. register: cik, name, ticker, and former: array of structs (name, from, to). Three equi-joins on
    normalised names and tickers, merged by entry; of several former names that match, the latest counts.
    """
    s = sample.select("ticker", plain_name(F.col("name")).alias("key"), F.upper(F.trim("ticker")).alias("symbol")).where("ticker IS NOT NULL")
    r = register.where("cik IS NOT NULL")
    none = F.lit(None).cast("date")
    current = r.select("cik", plain_name(F.col("name")).alias("key"), none.alias("a"), none.alias("b"), F.lit("current").alias("how"))
    former = r.select("cik", F.explode("former").alias("f")).select("cik", plain_name(F.col("f.name")).alias("key"), F.col("f.from").alias("a"), F.col("f.to").alias("b"), F.lit("former").alias("how"))
    named = s.join(current.unionByName(former).where("key <> ''"), "key").select("ticker", "cik", "a", "b", "how")
    symbol = s.join(r.select("cik", F.upper(F.trim("ticker")).alias("symbol")), "symbol").select("ticker", "cik", none.alias("a"), none.alias("b"), F.lit("ticker").alias("how"))
    own = lambda how: F.max(F.col("how") == how)
    span = F.max(F.when(F.col("how") == "former", F.struct("b", "a"))).alias("span")
    out = named.unionByName(symbol).groupBy("ticker", "cik").agg(own("current").alias("by_current"), own("former").alias("by_former"), own("ticker").alias("by_ticker"), span)
    return out.select("ticker", "cik", "by_current", "by_former", "by_ticker", F.col("span.a").alias("former_from"), F.col("span.b").alias("former_to"))


def adjudicate(sample: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """ticker, cik (where confirmed), status and rule for each row of sample; a ticker by itself is never an identity.

    sample: ticker, isin, panel, first_date, last_date. candidates: of name_candidates(). evidence: ticker, key_type
    (security_type or isin_cik), value (of a type), isin and cik. In order: a type that is no common stock rejects; an
    ISIN that the catalogue calls conflicting, or that leads to several entries, is to be reviewed; one entry by ISIN with an
    exact name, or one candidate whose former name was borne while the stock traded, is confirmed; several candidates, a
    match by ticker alone and a name without dates are to be reviewed; nothing at all is unresolved, and what is left
    is to be reviewed.
    """
    text = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    isin = lambda c: F.upper(F.trim(c))
    base = sample.select("ticker", isin(F.coalesce("isin", F.lit(""))).alias("isin"), "panel", "first_date", "last_date")
    e = evidence.select("ticker", "key_type", "value", isin(F.coalesce("isin", F.lit(""))).alias("e_isin"), F.col("cik").alias("e_cik"))
    found = base.select("ticker", "isin").join(e, "ticker").groupBy("ticker").agg(
        F.max((F.col("key_type") == "security_type") & ~F.coalesce(text(F.col("value")).isin(*COMMON), F.lit(False))).alias("other_type"),
        F.collect_set(F.when((F.col("key_type") == "isin_cik") & (F.col("e_isin") == F.col("isin")), F.col("e_cik"))).alias("ciks"),
        F.lit(True).alias("has_evidence"),
    )
    some = candidates.groupBy("ticker").agg(F.count("*").alias("n"), F.max(F.struct("cik", "by_current", "by_former", "by_ticker", "former_from", "former_to")).alias("c"), F.collect_set(F.when(F.col("by_current") | F.col("by_former"), F.col("cik"))).alias("named"), F.max(F.col("by_current") | F.col("by_former")).alias("any_name"))
    rows = base.join(found, "ticker", "left").join(some, "ticker", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce(F.size("ciks"), F.lit(0)), "has": F.coalesce("has_evidence", F.lit(False))})
    rows = rows.withColumn("k", F.greatest("k", F.lit(0)))
    one_isin = (F.col("k") == 1) & F.array_contains("named", F.col("ciks")[0])
    overlap = (F.col("n") == 1) & F.col("c.by_former") & (F.col("c.former_from") <= F.col("last_date")) & (F.col("first_date") <= F.col("c.former_to"))
    ladder = [
        (F.coalesce("other_type", F.lit(False)), "rejected", "security_type_contradiction"),
        ((F.col("panel") == "conflicting_isin") & (F.col("k") > 0), "review_required", "catalog_conflicting_isin"),
        (F.col("k") > 1, "review_required", "conflicting_isin_cik"),
        (one_isin, "confirmed", "isin_cik_plus_exact_name"),
        (overlap, "confirmed", "dated_former_name_overlap"),
        (F.col("n") > 1, "review_required", "competing_ciks"),
        ((F.col("n") == 1) & ~F.col("any_name"), "review_required", "ticker_only_match"),
        (F.col("n") == 1, "review_required", "undated_exact_name"),
        (~F.col("has"), "unresolved", "no_identity_candidates"),
    ]
    status, rule = F.lit("review_required"), F.lit("provider_evidence_only")
    for test, s, r in reversed(ladder):
        hit = F.coalesce(test, F.lit(False))
        status, rule = F.when(hit, s).otherwise(status), F.when(hit, r).otherwise(rule)
    cik = F.when(F.col("rule") == "isin_cik_plus_exact_name", F.col("ciks")[0]).when(F.col("rule") == "dated_former_name_overlap", F.col("c.cik"))
    return rows.select("*", status.alias("status"), rule.alias("rule")).select("ticker", cik.alias("cik"), "status", "rule")
