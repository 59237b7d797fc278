"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores.

A state emits a word class, and the class emits the word: P(word | state) = P(class | state) * P(word |
class). The FREQUENT most frequent words are classes of their own; other words fall into HASHED classes by
the hash of their last letters, where a word's share follows its count over the whole training text,
smoothed for unknown words. So the states' tables are bounded, and only the counts grow with the corpus.

Documents are read in blocks. A block writes down its words once, with their training counts, and its
texts as places in that list. Counts meet by word over all blocks and go back to the blocks that asked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, scratch_path

STATES, FREQUENT, HASHED, SUFFIX = 8, 2048, 2048, 3
#: Baum-Welch runs SWEEPS times over all training text in SHARES shares with an update after each share, then ROUNDS
#: times with one update for the whole. All rounds are sums over partitions; shares are a fixed part of any corpus.
SHARES, SWEEPS, ROUNDS = 8, 1, 2
#: Text bytes in a block, and tokens that go through the recursions at once.
BLOCK_BYTES, BATCH_TOKENS = 20 << 20, 1 << 18
SMOOTH = 0.1
END = FREQUENT + HASHED
CLASSES = END + 1
#: A class fits in so many bits; a word's count stands above them.
CLASS_BITS = 13

BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, words array<binary>, train array<int>"


def _pack(places: np.ndarray) -> bytes:
    """Places byte by byte, lowest bytes first, compressed: the high bytes are nearly all zero."""
    return zlib.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Block:
    """Texts of one block as places in its list of words; learning counts each word's places in training texts."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.learning = np.zeros(1 << 16, np.int32)
        self.doc_ids, self.held, self.lengths, self.ids, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, held: bool, text: bytes) -> None:
        words, place = text.lower().split(), self.place
        got = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words))
        if len(place) > len(self.learning):
            self.learning = np.concatenate([self.learning, np.zeros(len(place), np.int32)])
        if not held and len(got):
            at, n = np.unique(got, return_counts=True)
            self.learning[at] += n.astype(np.int32)
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(words))
        self.ids.append(got)
        self.size += len(text) + 64

    def row(self, number: int) -> pa.RecordBatch:
        row = [[number], [self.doc_ids], [self.held], [self.lengths], [_pack(np.concatenate(self.ids))], [list(self.place)], [self.learning[: len(self.place)]]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["block", "doc_ids", "held", "lengths", "ids", "words", "train"])


def read_blocks(docs: DataFrame) -> DataFrame:
    """A row for each block; ids are packed places in words; train counts words of training texts."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc_id, out, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    block.add(doc_id, out, text or b"")
                    if block.size > BLOCK_BYTES:
                        yield block.row(number)
                        number, block = number + 1, Block()
        if block.doc_ids:
            yield block.row(number)

    inner = docs.select("doc_id", held.alias("held"), F.col("text").cast("binary").alias("text"))
    return materialize(inner.mapInArrow(run, BLOCK), "blocks", "zstd")


def word_counts(blocks: DataFrame) -> DataFrame:
    """word and c, its count in the training texts; words met in held-out texts only have 0."""
    rows = blocks.select(F.explode(F.arrays_zip("words", "train")).alias("x"))
    return rows.groupBy(F.col("x.words").alias("word")).agg(F.sum(F.col("x.train").cast("long")).alias("c"))


def with_classes(counts: DataFrame) -> DataFrame:
    """counts with class: the rank among the FREQUENT, else a hash of the word's last SUFFIX characters."""
    spark = counts.sparkSession
    # The powers of two of the counts say from which count on there are enough words; few rows are left to rank.
    tally = sorted(((r["p"], r["n"]) for r in counts.where("c > 1").groupBy(F.floor(F.log2("c")).alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, seen = 2, 0
    for p, n in tally:
        least, seen = 2**p, seen + n
        if seen >= FREQUENT:
            break
    # At most FREQUENT rows, so they may go to the driver and to every task.
    top = [r["word"] for r in counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    ranks = spark.createDataFrame([(bytes(w), i) for i, w in enumerate(top)], "word binary, own int")
    hashed = F.pmod(F.crc32(F.expr(f"right(cast(word as string), {SUFFIX})")), F.lit(HASHED)) + FREQUENT
    return counts.join(F.broadcast(ranks), "word", "left").select("word", "c", F.coalesce("own", hashed.cast("int")).alias("class"))


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, classes binary"
EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("inside", pa.float64()), ("classes", pa.binary())])


def _coded(n_total: int, n_words: int, ends: int, in_class: np.ndarray, words_in: np.ndarray):
    """A block and its words' counts to documents as class sequences, with the sums that need no states."""
    base_low = n_total + SMOOTH * (n_words + 1)
    end_base = np.log10((ends + SMOOTH) / base_low)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows:
            return EMPTY.empty_table()
        row = {name: block.column(name)[0] for name in ("doc_ids", "held", "lengths", "ids")}
        place, packed = (np.asarray(found.column(name).combine_chunks()) for name in ("place", "packed"))
        c, cls = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        c[place], cls[place] = packed >> CLASS_BITS, packed & ((1 << CLASS_BITS) - 1)
        base = np.log10((c + SMOOTH) / base_low)
        inside = np.where(cls < FREQUENT, 0.0, np.log10((c + SMOOTH) / (in_class[cls] + SMOOTH * (words_in[cls] + 1))))
        seq = _unpack(row["ids"].as_py())
        at = np.concatenate([[0], np.cumsum(np.asarray(row["lengths"].values))])
        known, classes, last = c > 0, cls.astype("<u2"), np.array([END], "<u2").tobytes()
        out = [[], [], [], []]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = seq[a:b]
            for x, y in zip(out, (int(known[own].sum()) + (ends > 0), float(base[own].sum()) + end_base, float(inside[own].sum()), classes[own].tobytes() + last)):
                x.append(y)
        return pa.Table.from_arrays([row["doc_ids"].values, row["held"].values, pa.array(np.diff(at) + 1, pa.int64()), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.float64(), pa.float64(), pa.binary())))], schema=EMPTY)

    return run


class Model:
    """Start, transition and emission tables; all rows sum to one."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray) -> Model:
        rng = np.random.default_rng(17)
        emit = shares * rng.uniform(0.2, 1.8, (STATES, CLASSES))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, flat: np.ndarray, shares: np.ndarray) -> Model:
        """From summed counts; a small mass spread by the classes' overall shares keeps every emission above 0."""
        start, move = flat[:STATES] + 1.0, flat[STATES : STATES * (STATES + 1)].reshape(STATES, STATES) + 1.0
        emit = flat[STATES * (STATES + 1) :].reshape(STATES, CLASSES) + 50.0 * shares
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def batches_of(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of seqs, longest first, in batches of BATCH_TOKENS or so, so that little of a batch idles."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    batch, tokens = [], 0
    for i in order:
        batch.append(i)
        tokens += len(seqs[i])
        if tokens >= BATCH_TOKENS:
            yield batch
            batch, tokens = [], 0
    if batch:
        yield batch


def _by_time(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out time by time: (symbols, how many run at each time, where each time begins)."""
    lengths = np.array([len(s) for s in seqs])
    running = np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1)[::-1])[::-1][1:]
    begins = np.concatenate([[0], np.cumsum(running)])
    flat = np.empty(begins[-1], np.int64)
    for i, s in enumerate(seqs):
        flat[begins[: len(s)] + i] = s
    return flat, running, begins


def forward(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Scaled forward recursion: log10 likelihoods, state shares and scales by time, and the layout."""
    flat, running, begins = layout = _by_time(seqs)
    emitted = model.emit.T[flat]
    shares, scales = np.empty_like(emitted), np.empty(len(flat))
    for t, n in enumerate(running):
        at = begins[t]
        now = emitted[at : at + n] * (model.start if t == 0 else shares[begins[t - 1] : begins[t - 1] + n] @ model.move)
        scale = now.sum(1)
        scales[at : at + n] = scale
        np.divide(now, scale[:, None], out=shares[at : at + n])
    logs = np.log10(scales)
    total = np.zeros(len(seqs))
    for t, n in enumerate(running):
        total[:n] += logs[begins[t] : begins[t] + n]
    return total, shares, scales, (*layout, emitted)


def expected(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """Expected starts, moves and emissions of all sequences under the model, as one flat array."""
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
    for batch in batches_of(seqs):
        _, shares, scales, (flat, running, begins, emitted) = forward([seqs[i] for i in batch], model)
        back = np.ones((0, STATES))
        for t in range(len(running) - 1, -1, -1):
            at, n, later = begins[t], running[t], len(back)
            here = np.ones((n, STATES))
            if later:
                nxt = begins[t + 1]
                ahead = emitted[nxt : nxt + later] * back / scales[nxt : nxt + later, None]
                move += shares[at : at + later].T @ ahead
                here[:later] = ahead @ model.move.T
            back = here
            # Earlier times don't read these shares again, so the posteriors take their place.
            shares[at : at + n] *= back
        start += shares[: running[0]].sum(0)
        for k in range(STATES):
            emit[k] += np.bincount(flat, shares[:, k], CLASSES)
    return np.concatenate([start, (move * model.move).ravel(), emit.ravel()])


def _expected_rows(model: Model):
    """Sums the counts of a whole partition before anything is sent; a row for each parameter that isn't 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, tokens = None, [], 0

        def add() -> None:
            nonlocal total, held, tokens
            if held:
                got = expected(held, model)
                total = got if total is None else total + got
                held, tokens = [], 0

        for batch in batches:
            for raw in batch.column(0):
                held.append(np.frombuffer(raw.as_py(), "<u2"))
                tokens += len(held[-1])
                if tokens > 16 * BATCH_TOKENS:
                    add()
        add()
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    return run


def counted(seqs: DataFrame, model: Model) -> np.ndarray | None:
    """Expected counts of all sequences, as one flat array: a row for each parameter, STATES * (1 + STATES + CLASSES) at most."""
    rows = seqs.select("classes").mapInArrow(_expected_rows(model), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(STATES * (1 + STATES + CLASSES))
    for r in rows:
        flat[r["at"]] = r["n"]
    return flat if rows else None


def train(coded: DataFrame, shares: np.ndarray) -> Model:
    """Baum-Welch from seeded tables. coded has share, by which it is stored, so that a share is read by itself.

    Updates after each share let the states part early; the last rounds take their counts from all training text.
    A share without training text changes nothing.
    """
    learning = coded.where("NOT held_out")
    model = Model.first(shares)
    steps = [learning.where(F.col("share") == k) for _ in range(SWEEPS) for k in range(SHARES)] + [learning] * ROUNDS
    for seqs in steps:
        flat = counted(seqs, model)
        if flat is not None:
            model = Model.of_counts(flat, shares)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(batch.num_columns - 1)]
            total = np.zeros(len(seqs))
            for places in batches_of(seqs):
                total[places] = forward([seqs[i] for i in places], model)[0]
            score = pa.array(np.asarray(batch.column(batch.num_columns - 2)) + total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], score], [*batch.schema.names[:-2], "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Texts whose crc32(doc_id) mod 10 is 0 are held out; a null doc_id counts as the empty string (held
    out), a null text as empty (its end alone is scored). Without training texts all scores are those of the
    first tables. Repeated rows are scored each, and each counts in training. Words tied in count are ranked by their
    bytes. A text of any length is one sequence, held by one task. An empty table gives no rows; other columns are not read.
    """
    blocks = read_blocks(docs)
    counts = with_classes(materialize(word_counts(blocks), "counts", "zstd"))
    per_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.sum(F.expr("CASE WHEN c > 0 THEN 1 ELSE 0 END")).alias("v")).collect()
    in_class, words_in = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        in_class[r["class"]], words_in[r["class"]] = r["n"], r["v"]
    ends = blocks.agg(F.coalesce(F.sum(F.expr("size(filter(held, h -> NOT h))")), F.lit(0))).first()[0]
    n_total, n_words = int(in_class.sum()) + ends, int(words_in.sum()) + (ends > 0)
    shares = in_class.copy()
    shares[END] = ends
    shares = (shares + SMOOTH) / (shares.sum() + SMOOTH * CLASSES)
    asked = blocks.select("block", F.posexplode("words").alias("place", "word"))
    packed = F.shiftleft("c", CLASS_BITS).bitwiseOR(F.col("class").cast("long")).alias("packed")
    answers = asked.join(counts, "word").select(F.col("block").alias("of"), "place", packed)
    texts = blocks.select("block", "doc_ids", "held", "lengths", "ids")
    # A group is one block and the answers for its words: bounded by BLOCK_BYTES.
    coded = texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_coded(n_total, n_words, ends, in_class, words_in), CODED)
    share = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SHARES)).cast("int")
    path = scratch_path(docs.sparkSession, "coded")
    coded = coded.withColumn("share", share)
    coded.write.option("compression", "zstd").partitionBy("share").parquet(path)
    coded = docs.sparkSession.read.schema(coded.schema).parquet(path)
    model = train(coded, shares)
    out = coded.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_total).cast("long").alias("train_tokens"), "base_score", "inside", "classes")
    return out.mapInArrow(_scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
