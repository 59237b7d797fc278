"""Quality rules: every rule runs once and leaves a bit; versioned policies are masks over the ledger."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import apart, materialize

SYMBOLS = b"#*$%&|<>"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")  # any letter outside ASCII counts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "longest_word")

#: Rule name -> when it fails, over the measurements; the place in this order is the rule's bit for good.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 35 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "few_letters": "100 * n_letter_words < 80 * n_words",
    "giant_word": "longest_word > 1000",
    "many_words": "n_words > 1000000",
}

#: Policy version -> the rules that reject. Old versions stay, so that a corpus can be judged again as it was.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "few_letters", "giant_word"),
}
POLICY = "v2"


def mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[version])


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one text. bytes.split() parts words at exactly 0x20 and 0x09 to 0x0D; null counts as empty."""
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        to = 0  # words before this place are counted already
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, to)
                to = i + 3
    letters = sum(1 for w in words if LETTER.search(w))
    return (len(words), len(joined.decode("utf-8", "replace")), len(joined) - len(joined.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated, letters, max(map(len, words), default=0))


def _measured(keep_text: bool):
    """Adds the measurements of the text, the last column, to a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            found = [m for at in range(0, len(text), 256) for m in map(measure, text.slice(at, 256).cast(pa.binary()).to_pylist())]
            columns = batch.columns if keep_text else batch.columns[:-1]
            names = batch.schema.names[: len(columns)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in found], pa.int64()) for i in range(len(MEASURES)))], [*names, *(f"__{m}" for m in MEASURES)])

    return run


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' columns (without text unless asked), then `__`-named measurements and __failed, the bits of the failed rules.

    A null or empty text has no words, so few_words fails. Texts are measured whole. Rows stay apart, repeated ones too;
    an empty table gives none. Columns of docs that are named like the ledger's own get an underscore.
    """
    names = [*(c for c in docs.columns if c != text), text]
    # Columns go through under numbers, so that no name of theirs can clash.
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    names = names if keep_text else names[:-1]
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), *(f"__{m} long" for m in MEASURES)])
    out = inner.mapInArrow(_measured(keep_text), schema)
    shown = apart(names, [*(f"__{m}" for m in MEASURES), "__failed"])
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(shown)), *(f"__{m}" for m in MEASURES), failures().alias("__failed"))


def failures() -> Column:
    bits = None
    for bit, rule in enumerate(RULES.values()):
        for m in sorted(MEASURES, key=len, reverse=True):
            rule = " ".join(f"__{m}" if w == m else w for w in rule.split(" "))
        one = F.expr(f"CASE WHEN {rule} THEN {1 << bit}L ELSE 0L END")
        bits = one if bits is None else bits.bitwiseOR(one)
    return bits


def passes(failed: Column, version: str) -> Column:
    return failed.bitwiseAND(F.lit(mask(version))) == 0


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """rule, n_failed, n_only: rows that fail a rule of the policy, and those that only this rule rejects.

    The ledger is first counted by its distinct bit sets, at most 2 to the number of rules, so the
    shuffle is small at any size.
    """
    sets = rows.groupBy(F.col("__failed").bitwiseAND(F.lit(mask(version))).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[version])))
    each = sets.select("bits", "n", rules.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def keep_good(docs: DataFrame, version: str = POLICY) -> DataFrame:
    """The rows of docs that pass the policy, with docs' columns as they were."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = ledger(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names["text"], keep_text=True)
    return rows.where(passes(F.col("__failed"), version)).select(*(F.col(n).alias(c) for c, n in names.items()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, with the verdicts of the base policy and the newest.

    only_rule is the rule without which the newest policy would keep the document, n_only how many it would so gain.
    """
    rows = materialize(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "ledger")
    bits = F.col("__failed").bitwiseAND(F.lit(mask(POLICY)))
    names = list(RULES)
    only = F.lit(None).cast("string")
    for rule in POLICIES[POLICY]:
        only = F.when(bits == 1 << names.index(rule), rule).otherwise(only)
    # A row for each rule of the policy.
    freed = F.broadcast(ablations(rows, POLICY).select(F.col("rule").alias("only_rule"), "n_only"))
    rows = rows.withColumn("only_rule", only).join(freed, "only_rule", "left")
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id",
        *(F.col(f"__{m}").alias(m) for m in shown),
        (~passes(F.col("__failed"), "base")).alias("base_failed"),
        passes(F.col("__failed"), POLICY).alias("kept"),
        F.col("__failed").alias("failed_bits"),
        "only_rule",
        "n_only",
    )


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), covered AS (
  SELECT doc_id, count(DISTINCT i + d)::BIGINT AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows
  ), (SELECT unnest([0, 1, 2]) AS d) WHERE times > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words,
    coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest_word
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), bits AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 35 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT
    + 64 * (100 * n_letter_words < 80 * n_words)::BIGINT + 128 * (longest_word > 1000)::BIGINT + 256 * (n_words > 1000000)::BIGINT AS failed_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 255) = 0 AS kept, failed_bits, only_rule,
  CASE WHEN only_rule IS NOT NULL THEN count(*) OVER (PARTITION BY only_rule) END AS n_only
FROM (
  SELECT *, CASE failed_bits & 255 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words'
    WHEN 64 THEN 'few_letters' WHEN 128 THEN 'giant_word' END AS only_rule FROM bits)
"""
