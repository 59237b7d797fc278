"""Document fingerprints after I-Match, in DataFrame functions only.

The lexicon keeps the terms whose inverse document frequency lies in a band. A document's distinct lexicon terms are sorted and
hashed, once for the whole lexicon and once for each of 32 random subsets of it, which keep every 8th to every 512th term. Subsets that keep most terms agree only between near copies; those that keep few agree about as often as the documents share
terms. So the share of signatures in which two fingerprints agree is a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_order, materialize

#: The band: ln(N / df) / ln(N) of a kept term, for N documents of which df have the term. So df is from N^0.4 to N^0.95.
BAND = (0.05, 0.6)
#: Random subsets of the lexicon: each keeps one term in 2 to the power of this.
HALVINGS = [3] * 2 + [4] * 3 + [5] * 4 + [6] * 5 + [7] * 6 + [8] * 6 + [9] * 6
SUBSETS = len(HALVINGS)
#: Where the lists begin from which subsets are picked.
LISTS = [0, 9, SUBSETS]
#: A lexicon of more terms than these is joined by a shuffle in place of a broadcast (about 100 bytes a term).
BROADCAST_TERMS = 1_000_000
#: Hexadecimal digits of a signature.
DIGITS = 8
#: The signature of no term: the beginning of the MD5 of an empty list, written as "[]".
EMPTY = hashlib.md5(b"[]").hexdigest()[:DIGITS]

#: What parts terms: all ASCII but letters and digits.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), PARTS)), "")


def lexicon(df: DataFrame, text: str, band: tuple[float, float] = BAND) -> DataFrame:
    """term, code (60 bits that stand for it) and mask (its subsets as bits), for the terms in the band over all rows of df."""
    counted = materialize(df.select(F.explode(terms(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("docs")), "termdocs")
    n = df.count()
    rarity, whole = F.log(F.lit(float(n)) / F.col("docs")), F.log(F.lit(float(max(n, 1))))
    digest = F.concat(F.sha2("term", 256), F.sha2(F.concat(F.lit(" "), "term"), 256))
    kept = counted.where((rarity >= band[0] * whole) & (rarity <= band[1] * whole)).select("term", digest.alias("digest"))
    drawn = [F.when(F.substring("digest", 3 * k + 1, 3) < F.lit(f"{4096 >> h:03x}"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, h in enumerate(HALVINGS)]
    mask = drawn[0]
    for bit in drawn[1:]:
        mask = mask + bit
    return kept.select("term", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("code"), (mask + F.lit(1 << SUBSETS)).alias("mask"))


def _signed(df: DataFrame, found: str, text_sha: Column, name: str) -> DataFrame:
    """df with all signatures, one after another, as `name`. found: sorted array of (code, mask) of a document's lexicon terms; one without any is hashed as a whole.

    Subsets that keep few terms are picked from a list that holds just those of their kind.
    """
    parts = []

    def of(held: str, bits: int) -> Column:
        return F.filter(held, lambda t: t["mask"].bitwiseAND(F.lit(bits)) != 0)

    for first, last in zip(LISTS, LISTS[1:]):
        df = df.withColumn(f"__{first}", of(found, (1 << last) - (1 << first)))
        parts.append((first, last, f"__{first}"))

    def hashed(terms_of: Column) -> Column:
        return F.substring(F.md5(terms_of["code"].cast("string").cast("binary")), 1, DIGITS)

    made = [hashed(of(held, 1 << k)) for first, last, held in parts for k in range(first, last)]
    alone = F.repeat(F.substring(F.md5(F.concat(F.lit("text "), text_sha).cast("binary")), 1, DIGITS), SUBSETS + 1)
    return df.withColumn(name, F.unhex(F.when(F.size(found) == 0, alone).otherwise(F.concat(*made, hashed(F.col(found)))))).drop(*(held for _, _, held in parts))


def likeness(one: str, two: str) -> Column:
    """Share of the signatures in which two fingerprints agree, among those that are not of no term in both."""
    agree, counted = [], []
    for k in range(SUBSETS + 1):
        a, b = f"substr({one}, {DIGITS * k + 1}, {DIGITS})", f"substr({two}, {DIGITS * k + 1}, {DIGITS})"
        agree.append(f"if({a} = {b} AND {a} <> '{EMPTY}', 1, 0)")
        counted.append(f"if({a} = '{EMPTY}' AND {b} = '{EMPTY}', 0, 1)")
    return F.expr(f"cast({' + '.join(agree)} AS double) / ({' + '.join(counted)})")


def _order(df: DataFrame) -> tuple[DataFrame, bool]:
    """k, nil (the key without null), pick, and the keys of the next and of the one before in descending order, with half its length; and whether a key repeats.

    pick: hash of the text that stands for the key where rows repeat it.
    """
    keys = df.groupBy("k", "nil").agg(F.min("hash").alias("pick"), F.max("n").alias("n"), F.count("*").alias("times"))
    placed = in_order(keys.withColumn("rank", F.when(F.col("nil"), 0).otherwise(1)), ["rank", "k"], "order")
    own = F.struct("k", "nil", "n").alias("own")
    within = Window.partitionBy("part").orderBy("row")
    near = placed.select("part", "row", "pick", own).select("*", F.lag("own").over(within).alias("below"), F.lead("own").over(within).alias("above"))
    # One row for each range partition: the last of the one before, the first of the one behind, in a ring.
    ends = placed.groupBy("part").agg(F.min_by(F.struct("k", "nil", "n"), "row").alias("first"), F.max_by(F.struct("k", "nil", "n"), "row").alias("last"))
    ring = Window.orderBy("part")
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(ring), F.last("last").over(every)).alias("under"), F.coalesce(F.lead("first").over(ring), F.first("first").over(every)).alias("over"))
    near = near.join(F.broadcast(ends), "part")
    below, above = F.coalesce("below", "under"), F.coalesce("above", "over")
    out = near.select("own.k", "own.nil", "pick", below["k"].alias("next_k"), below["nil"].alias("next_nil"), above["k"].alias("prev_k"), above["nil"].alias("prev_nil"), (F.expr("coalesce(above, over).n") / 2).cast("int").alias("half"))
    return materialize(out, "neighbours"), placed.where("times > 1").limit(1).count() > 0


def fingerprints(df: DataFrame, key: str, text: str, band: tuple[float, float] = BAND, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """key (an integer), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of df.

    The edited text is the text whose last half comes from the beginning of the next document, in descending order of the key; after the last
    comes the first, and a null key is last of all. A null text counts as empty. Rows that repeat a key have the same next document;
    of several rows with the next key the one of the least text hash is the next. A text without lexicon terms is hashed as a
    whole. Texts of any length are taken whole; an empty table gives no rows; other columns are not read.

    Whole texts are shuffled once, by key, and beginnings of texts once more; the rows of a document's terms stay in its task unless
    the lexicon is too large to be broadcast.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    put = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0).cast("long")).alias("k"), F.col(f"`{key}`").isNull().alias("nil"), body.alias("text"))
    kept = materialize(lexicon(df, text, band), "lexicon")
    if kept.count() <= broadcast_terms:
        kept = F.broadcast(kept)
    order, repeats = _order(put.select("k", "nil", F.xxhash64("text").alias("hash"), F.char_length("text").alias("n")))
    placed = put.join(order, ["k", "nil"])
    # Not written as an equality, which would be a key of the join below and keep the shuffle of the texts from being used twice.
    begins = placed.where(F.expr("(xxhash64(text) ^ pick) = 0")).select(F.col("prev_k").alias("k"), F.col("prev_nil").alias("nil"), F.expr("left(text, half)").alias("begin"))
    if repeats:
        begins = begins.dropDuplicates(["k", "nil"])
    n = F.char_length("text")
    both = placed.join(begins, ["k", "nil"]).select("k", "nil", "pick", "prev_k", "prev_nil", n.alias("n"), "text", F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), F.expr("left(begin, char_length(text) div 2)")).alias("edited"))
    info = F.struct("n", F.unhex(F.sha2("text", 256)).alias("sha"), F.unhex(F.sha2("edited", 256)).alias("edited_sha"), "prev_k", "prev_nil", (F.xxhash64("text") == F.col("pick")).alias("stands"))
    rows = both.select("k", "nil", F.monotonically_increasing_id().alias("rid"), info.alias("info"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("other"))
    # A term of both texts is one row: first the shared ones, then those of the text alone, then those of the edited text alone.
    rows = rows.select("k", "nil", "rid", "info", F.array_intersect("own", "other").alias("shared"), F.array_except("own", "other").alias("own"), F.array_except("other", "own").alias("other"))
    rows = rows.select("k", "nil", "rid", "info", F.size("shared").alias("n_shared"), F.size("own").alias("n_own"), F.posexplode_outer(F.concat("shared", "own", "other")).alias("at", "term"))
    found = rows.join(kept, "term", "left").where("coalesce(at, 0) = 0 OR code IS NOT NULL")
    hit = F.when(F.col("code").isNotNull(), F.struct("code", "mask"))
    mine, others = F.expr("at < n_shared + n_own"), F.expr("at < n_shared OR at >= n_shared + n_own")
    found = found.select("k", "nil", "rid", F.expr("if(coalesce(at, 0) = 0, info, null)").alias("info"), hit.alias("hit"), mine.alias("mine"), others.alias("others"))
    listed = lambda when: F.sort_array(F.collect_list(F.when(F.col(when), F.col("hit"))))
    found = found.groupBy("k", "nil", "rid").agg(F.first("info", ignorenulls=True).alias("info"), listed("mine").alias("own"), listed("others").alias("other"))
    printed = _signed(_signed(found, "own", F.lower(F.hex("info.sha")), "fp"), "other", F.lower(F.hex("info.edited_sha")), "edited_fp")
    printed = materialize(printed.select("k", "nil", "info", "fp", "edited_fp"), "fingerprints", "zstd")
    following = printed.where("info.stands").select(F.col("info.prev_k").alias("k"), F.col("info.prev_nil").alias("nil"), F.col("fp").alias("next_fp"))
    if repeats:
        following = following.dropDuplicates(["k", "nil"])
    out = printed.join(following, ["k", "nil"]).select("k", "nil", "info", *(F.lower(F.hex(c)).alias(c) for c in ("fp", "edited_fp", "next_fp")))
    own_key = F.when(~F.col("nil"), F.col("k")).cast(df.schema[key].dataType)
    return out.select(own_key.alias(key), F.col("info.n").cast("long").alias("n_chars"), F.lower(F.hex("info.edited_sha")).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the lexicon of all documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def _like_sql(a: str, b: str) -> str:
    at = lambda x: f"substr({x}, {DIGITS} * k + 1, {DIGITS})"
    return f"""(SELECT sum(CASE WHEN {at(a)} = {at(b)} AND {at(a)} <> '{EMPTY}' THEN 1 ELSE 0 END)::DOUBLE
      / sum(CASE WHEN {at(a)} = '{EMPTY}' AND {at(b)} = '{EMPTY}' THEN 0 ELSE 1 END)::DOUBLE FROM range({SUBSETS + 1}) r(k))"""


OP13_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next_text,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
  FROM documents
), texts AS (
  SELECT doc_id, 0 AS which, text FROM docs UNION ALL SELECT doc_id, 1, left(text, n - n // 2) || left(next_text, n // 2) FROM docs
), termed AS (
  SELECT doc_id, which, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '{PARTS}'), lambda t: t <> '')) AS terms FROM texts
), counted AS (
  SELECT term, count(*) AS docs FROM (SELECT unnest(terms) AS term FROM termed WHERE which = 0) GROUP BY term
), lexicon AS (
  SELECT term, ('0x' || substr(sha256(term), 1, 15))::BIGINT AS code, sha256(term) || sha256(' ' || term) AS digest
  FROM counted, (SELECT count(*) AS n FROM documents)
  WHERE ln(n::DOUBLE / docs) BETWEEN {BAND[0]} * ln(n::DOUBLE) AND {BAND[1]} * ln(n::DOUBLE)
), hits AS (
  SELECT t.doc_id, t.which, l.code, l.digest FROM (SELECT doc_id, which, unnest(terms) AS term FROM termed) t JOIN lexicon l USING (term)
), signed AS (
  SELECT doc_id, which, k, substr(md5('[' || coalesce(string_agg(code::VARCHAR, ', ' ORDER BY code) FILTER (k = {SUBSETS} OR substr(digest, 3 * k + 1, 3) < printf('%03x', 4096 >> h)), '') || ']'), 1, {DIGITS}) AS sig
  FROM hits, (SELECT unnest(range({SUBSETS + 1}))::INTEGER AS k, unnest({[*HALVINGS, 0]})::INTEGER AS h) GROUP BY doc_id, which, k
), joined AS (SELECT doc_id, which, string_agg(sig, '' ORDER BY k) AS fp FROM signed GROUP BY doc_id, which),
printed AS (
  SELECT t.doc_id, t.which, t.text, coalesce(j.fp, repeat(substr(md5('text ' || sha256(t.text)), 1, {DIGITS}), {SUBSETS + 1})) AS fp
  FROM texts t LEFT JOIN joined j ON j.doc_id = t.doc_id AND j.which = t.which
)
SELECT d.doc_id, d.n::BIGINT AS n_chars, sha256(e.text) AS edited_sha256, p.fp AS fingerprint, e.fp AS edited_fingerprint,
  {_like_sql('p.fp', 'e.fp')} AS near_edited, {_like_sql('p.fp', 'x.fp')} AS near_next
FROM docs d JOIN printed p ON p.doc_id = d.doc_id AND p.which = 0 JOIN printed e ON e.doc_id = d.doc_id AND e.which = 1
JOIN printed x ON x.doc_id = d.next_id AND x.which = 0
"""
