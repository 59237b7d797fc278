"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text, for each language.

The units are characters (lower case, white space as one space), the order is four. An n-gram is one long:
the language's number over four symbols of 12 bits, so counting, suffixes and contexts are bit operations
and every table is sharded by the n-gram itself. A first pass over the texts lists their distinct n-grams
and counts those of trusted documents; joins sharded by n-gram give each its probability. The answers go
back to the texts in a broadcast while they are few (TABLE_ROWS, checked), else block by block in a cogroup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

ORDER, WIDTH = 4, 12
SYMBOLS = 1 << WIDTH
#: Code points below this are symbols of their own; others share the rest of the symbols by a hash.
PLAIN = 0x300
#: Languages with a model of their own (the most frequent), as many as a key has room for; others and null share number 0.
LANGUAGES = (1 << 63 - ORDER * WIDTH) - 1
#: One trusted document in so many sets the quantiles and not the counts.
CALIBRATION = 5
#: A document goes where its log perplexity lies over its language's median by more than this quantile of the calibrating
#: documents does, both times the root of the symbols: a mean over n symbols scatters as 1 / sqrt(n).
HIGH = 0.99
#: A language's own median and quantile weigh as its calibrating documents, against so many for what stands in for them.
CENTRE_WEIGHT, FENCE_WEIGHT = 5, 20
#: Log perplexities nearer than this are equal.
ROUNDING = 1e-9
#: Documents that training_ids() chooses, about.
TRAINING = 20_000
#: Doc_ids of trusted documents that may go to every task.
BROADCAST_IDS = 1_000_000
#: N-grams with their probabilities (16 bytes each) that may go to every task.
TABLE_ROWS = 3_000_000
BLOCK_CHARS, CHUNK = 8 << 20, 1 << 20

BLOCK = "block long, doc_ids array<long>, langs array<int>, lengths array<int>, symbols binary, grams array<long>"


def symbols_of(text: str | None) -> np.ndarray:
    """Symbols from 1; 0 stands before a text's start."""
    cp = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    rest = PLAIN + (cp * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - PLAIN)
    return np.maximum(np.where(cp < PLAIN, cp, rest), 1).astype("<u2")


def grams_of(symbols: np.ndarray, lengths: np.ndarray, langs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, document after the last, their n-grams one for each symbol), some documents at a time."""
    ends = np.cumsum(lengths)
    doc = 0
    while doc < len(lengths):
        base = ends[doc] - lengths[doc]
        to = max(doc + 1, int(np.searchsorted(ends, base + CHUNK)))
        some = lengths[doc:to]
        # Each text with ORDER - 1 zeros before it.
        at = np.repeat(np.arange(1, len(some) + 1) * (ORDER - 1), some) + np.arange(int(some.sum()))
        padded = np.zeros(int(some.sum()) + (ORDER - 1) * len(some), np.int64)
        padded[at] = symbols[base : ends[to - 1]]
        keys = np.repeat(langs[doc:to].astype(np.int64), some) << ORDER * WIDTH
        for k in range(ORDER):
            keys |= padded[at - k] << k * WIDTH
        yield doc, to, keys
        doc = to


def _texts(batches: Iterator[pa.RecordBatch], numbers: dict[str, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, language numbers, lengths, symbols) of up to BLOCK_CHARS symbols, from batches of id, lang and text."""
    ids, langs, texts, size = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for i, lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                ids.append(i)
                langs.append(numbers.get(lang, 0))
                texts.append(symbols_of(text))
                size += len(texts[-1]) + 16
                if size > BLOCK_CHARS:
                    yield ids, np.array(langs), np.array([len(t) for t in texts]), np.concatenate(texts)
                    ids, langs, texts, size = [], [], [], 0
    if ids:
        yield ids, np.array(langs), np.array([len(t) for t in texts]), np.concatenate(texts)


def _tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of n of each."""
    codes, found = pd.factorize(keys)
    return found, np.bincount(codes, n, len(found)).astype(np.int64)


def count_grams(docs: DataFrame, numbers: dict[str, int], training: DataFrame) -> DataFrame:
    """g and n: every n-gram of docs, and how often the documents of training (distinct doc_ids) have it (0 if never).

    Few doc_ids go to all tasks; over BROADCAST_IDS of them the texts are dealt by doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for used, langs, lengths, symbols in _texts(batches, numbers):
            used = np.array(used, bool)
            # Summed up chunk by chunk, so that a block holds each n-gram once for each of its chunks.
            parts = [_tally(keys, np.repeat(used[doc:to], lengths[doc:to])) for doc, to, keys in grams_of(symbols, lengths, langs)]
            g, n = _tally(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["g", "n"])

    marks = training.select("doc_id", F.lit(True).alias("used"))
    marks = F.broadcast(marks) if training.count() <= BROADCAST_IDS else marks
    rows = docs.select("doc_id", "lang", "text").join(marks, "doc_id", "left").select(F.coalesce("used", F.lit(False)).alias("used"), "lang", "text")
    return materialize(rows.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "grams")


def read_blocks(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """Texts in blocks with their distinct n-grams, for the way without a broadcast; docs has rid, lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())]
        for ids, langs, lengths, symbols in _texts(batches, numbers):
            grams = pd.unique(np.concatenate([pd.unique(k) for _, _, k in grams_of(symbols, lengths, langs)]))
            row = [[number], [ids], [langs], [lengths], [symbols.tobytes()], [grams]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["block", "doc_ids", "langs", "lengths", "symbols", "grams"])
            number += 1

    return materialize(docs.select("rid", "lang", "text").mapInArrow(run, BLOCK), "blocks", "zstd")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of what all labels call good and none toxic; calibrates is whether it sets quantiles."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("doc_id IS NOT NULL AND q = 1 AND coalesce(t, 0) = 0")
    return good.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % CALIBRATION == 0).alias("calibrates"))


def level(sizes: list[int], room: int) -> int:
    """The most that each may have of its size so that all together have `room` at most; 1 at least."""
    sizes = sorted(sizes)
    for i, n in enumerate(sizes):
        if n * (len(sizes) - i) > room:
            return max(1, room // (len(sizes) - i))
        room -= n
    return max([1, *sizes])


def training_ids(trusted: DataFrame, docs: DataFrame, numbers: dict[str, int]) -> list[int]:
    """About TRAINING trusted doc_ids by their hash, or all if they are fewer. For looking at a model by hand: judged() counts all trusted documents.

    The room is dealt out by language: one with few documents keeps them all, the others share the rest alike.
    """
    rest = trusted.where("NOT calibrates").select("doc_id")
    if rest.count() > TRAINING:
        spark = docs.sparkSession
        known = spark.createDataFrame(list(numbers.items()), "lang string, number int")
        own = docs.select("doc_id", "lang").join(rest, "doc_id").join(F.broadcast(known), "lang", "left")
        own = materialize(own.select("doc_id", F.coalesce("number", F.lit(0)).alias("number")).distinct(), "trusted")
        sizes = {r["number"]: r["count"] for r in own.groupBy("number").count().collect()}
        most = level(list(sizes.values()), TRAINING)
        share = spark.createDataFrame([(k, round(min(1.0, most / n) * 1_000_000_000)) for k, n in sizes.items()], "number int, share long")
        rest = own.join(F.broadcast(share), "number").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < F.col("share")).select("doc_id").distinct()
    return [r["doc_id"] for r in rest.collect()]


def _low(g: Column, n: int) -> Column:
    """The language and the last n symbols."""
    return g.bitwiseAND(F.lit(-1 << ORDER * WIDTH | (1 << n * WIDTH) - 1))


def _context(g: Column, n: int) -> Column:
    """The language and the first n - 1 of the n symbols."""
    return F.shiftright(g, ORDER * WIDTH) * (1 << ORDER * WIDTH) + F.shiftright(g.bitwiseAND(F.lit((1 << n * WIDTH) - 1)), WIDTH)


def _lang(g: Column) -> Column:
    return F.shiftright(g, ORDER * WIDTH).cast("int")


def orders(counts: DataFrame) -> list[DataFrame]:
    """(g, n) by order from 1: counts at the top, below it the number of different symbols met before."""
    out = [counts]
    for n in range(ORDER - 1, 0, -1):
        out.append(out[-1].groupBy(_low(F.col("g"), n).alias("g")).agg(F.count("*").alias("n")))
    return out[::-1]


def discounts(counts: DataFrame) -> DataFrame:
    """lang and the modified Kneser-Ney discounts d1 to d3 from the counts of counts; 0.5, 1, 1.5 where those are missing."""
    tally = counts.groupBy(_lang(F.col("g")).alias("lang")).agg(*(F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (value > 0) & (value < k), value).otherwise(k / 2).alias(f"d{k}")

    return tally.select("lang", *(d(k) for k in (1, 2, 3)))


def probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """g and log_p (natural) of every n-gram asked for, seen or not.

    From order 1 up, each order's distinct n-grams are joined to their count, their context's total and
    mass, and the shorter n-gram's probability, all by key.
    """
    needed = [asked.select("g")]
    for n in range(ORDER - 1, 0, -1):
        needed.append(needed[-1].select(_low(F.col("g"), n).alias("g")).distinct())
    lower = None
    for n, (rows, want) in enumerate(zip(orders(counts), needed[::-1]), 1):
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        kept = rows.withColumn("lang", _lang(F.col("g"))).join(F.broadcast(discounts(rows)), "lang").select("g", "n", cut.alias("cut"))
        contexts = kept.groupBy(_context(F.col("g"), n).alias("ctx")).agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        found = want.select("g", _context(F.col("g"), n).alias("ctx")).join(kept, "g", "left").join(contexts, "ctx", "left")
        if lower is None:
            below = F.lit(1.0 / SYMBOLS)
        else:
            found = found.withColumn("low", _low(F.col("g"), n - 1)).join(lower.select(F.col("g").alias("low"), F.col("p").alias("below")), "low")
            below = F.col("below")
        own = F.coalesce((F.col("n") - F.col("cut")) / F.col("total"), F.lit(0.0))
        lower = materialize(found.select("g", F.when(F.col("total").isNull(), below).otherwise(own + F.col("mass") / F.col("total") * below).alias("p")), "order")
    return lower.select("g", F.log("p").alias("log_p"))


def _summed(block: pa.Table, found: pa.Table) -> pa.Table:
    """A block and its n-grams' probabilities to the sum of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.int32()), ("n_chars", pa.int64()), ("log_p", pa.float64())])
    if not block.num_rows:
        return schema.empty_table()
    langs, lengths = (np.asarray(block.column(name)[0].values) for name in ("langs", "lengths"))
    symbols = np.frombuffer(block.column("symbols")[0].as_py(), "<u2")
    index, logs = pd.Index(np.asarray(found.column("g").combine_chunks())), np.asarray(found.column("log_p").combine_chunks())
    total = np.zeros(len(lengths))
    for doc, to, keys in grams_of(symbols, lengths, langs):
        each = np.repeat(np.arange(to - doc), lengths[doc:to])
        total[doc:to] = np.bincount(each, logs[index.get_indexer(keys)], to - doc)
    return pa.Table.from_arrays([block.column("doc_ids")[0].values, pa.array(langs), pa.array(lengths, pa.int64()), pa.array(total)], schema=schema)


def _scored(table, numbers: dict[str, int]):
    """Adds lang, n_symbols and log_p to batches whose first two columns are lang and text; those two go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs = table.value
        index = pd.Index(grams)
        for batch in batches:
            langs, lengths, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            whole = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int8()), *batch.columns[:2]], ["id", "lang", "text"])
            for _, lang, length, symbols in _texts(iter([whole]), numbers):
                sums = np.zeros(len(length))
                for doc, to, keys in grams_of(symbols, length, lang):
                    each = np.repeat(np.arange(to - doc), length[doc:to])
                    sums[doc:to] = np.bincount(each, logs[index.get_indexer(keys)], to - doc)
                langs.append(lang)
                lengths.append(length)
                total.append(sums)
            found = [pa.array(np.concatenate(langs), pa.int32()), pa.array(np.concatenate(lengths), pa.int64()), pa.array(np.concatenate(total))]
            yield pa.RecordBatch.from_arrays([*found, *batch.columns[2:]], ["lang", "n_symbols", "log_p", *batch.schema.names[2:]])

    return run


def perplexities(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """lang (a number), n_symbols, log_ppl (null for a text without symbols) and the columns `carry` as c0, c1 and so on.

    A row for each of docs, written down.
    """
    seen = docs.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    numbers = {r["lang"]: i + 1 for i, r in enumerate(seen.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())}
    training = materialize(trusted_ids(labels).where("NOT calibrates").select("doc_id"), "training")
    counts = count_grams(docs, numbers, training)
    known = probabilities(counts.select("g"), counts.where("n > 0"))
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    if counts.count() <= TABLE_ROWS:
        table = known.toArrow()
        held = docs.sparkSession.sparkContext.broadcast((table.column("g").to_numpy(), table.column("log_p").to_numpy()))
        rows = docs.select("lang", "text", *kept).mapInArrow(_scored(held, numbers), ", ".join(["lang int, n_symbols long, log_p double", *kinds]))
    else:
        numbered = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "lang", "text", *kept), "numbered", "zstd")
        blocks = read_blocks(numbered, numbers)
        answers = blocks.select(F.col("block").alias("of"), F.explode("grams").alias("g")).join(known, "g")
        texts = blocks.select("block", "doc_ids", "langs", "lengths", "symbols")
        # A group is one block and the answers for its n-grams: bounded by BLOCK_CHARS.
        sums = texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_summed, "doc_id long, lang int, n_chars long, log_p double")
        sums = sums.select(F.col("doc_id").alias("rid"), "lang", F.col("n_chars").alias("n_symbols"), "log_p")
        rows = numbered.drop("lang", "text").join(sums, "rid").drop("rid")
    return materialize(rows.select("lang", "n_symbols", F.when(F.col("n_symbols") > 0, -F.col("log_p") / F.col("n_symbols")).alias("log_ppl"), *(f"c{i}" for i in range(len(carry)))), "perplexities", "zstd")


def judged(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """perplexities() with threshold and kept.

    Each language's threshold comes from its calibrating documents: their median, and the HIGH quantile of
    the excess over it times the root of the symbols, so a long text's threshold is nearer to the median.
    Where these are few, the median of all texts of the language and the quantile of all languages' calibrating
    documents (of all texts, if there are none) weigh in. A text of a language without trusted text is as likely
    as any other and stays; a text without symbols is not kept. A null language counts as one of its own, as do
    all beyond the LANGUAGES most frequent together.
    """
    found = perplexities(docs, labels, carry)
    calibrating = trusted_ids(labels).where("calibrates").select(F.col("doc_id").alias("id"))
    read = found.where("log_ppl IS NOT NULL").select("lang", "log_ppl", "n_symbols", F.col(f"c{carry.index('doc_id')}").alias("id"))
    sure = materialize(read.join(calibrating, "id", "left_semi").select("lang", "log_ppl", "n_symbols"), "sure")
    # Sketches of bounded size for each language, merged over the partitions; at most LANGUAGES + 1 rows.
    usual = read.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10000).alias("usual"))
    own = sure.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("log_ppl", 0.5, 10000).alias("middle"))
    n = F.coalesce("n", F.lit(0))
    centre = (n * F.coalesce("middle", F.lit(0.0)) + CENTRE_WEIGHT * F.col("usual")) / (n + CENTRE_WEIGHT)
    centres = materialize(usual.join(F.broadcast(own), "lang", "left").select("lang", n.alias("n"), centre.alias("centre")), "centres")

    def fence(rows: DataFrame, *by: str) -> DataFrame:
        over = (F.col("log_ppl") - F.col("centre")) * F.sqrt("n_symbols")
        return rows.join(F.broadcast(centres), "lang").groupBy(*by).agg(F.percentile_approx(over, HIGH, 10000).alias("q"))

    pooled = fence(sure).first()["q"]
    if pooled is None:
        pooled = fence(read).first()["q"]
    fenced = centres.join(F.broadcast(fence(sure, "lang")), "lang", "left")
    fences = fenced.select("lang", "centre", ((F.col("n") * F.coalesce("q", F.lit(0.0)) + FENCE_WEIGHT * F.lit(pooled)) / (F.col("n") + FENCE_WEIGHT)).alias("fence"))
    threshold = F.col("centre") + F.col("fence") / F.sqrt("n_symbols")
    good = F.col("log_ppl") <= F.col("threshold") + ROUNDING
    placed = found.join(F.broadcast(fences), "lang", "left").withColumn("threshold", F.when(F.col("n_symbols") > 0, threshold)).drop("centre", "fence")
    return placed.withColumn("kept", F.coalesce(good, F.lit(False)))


def keep_likely(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with docs' columns."""
    return judged(docs, labels, docs.columns).where("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged() of all documents; perplexity and threshold are of one symbol."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels, ["doc_id"]).select(F.col("c0").alias("doc_id"), "n_symbols", F.exp("log_ppl").alias("perplexity"), F.exp("threshold").alias("threshold"), "kept")
