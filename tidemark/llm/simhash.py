"""SimHash near-duplicates through a hierarchical index in Gray order.

The bits of a fingerprint are cut into blocks. Fingerprints within D bits agree in at least `more` of D + more
blocks, so there is one table for each choice of that many blocks. In a table the chosen blocks lead, and rows are sorted by
Gray rank, in which neighbours differ in few bits. A run is what has the same first bits of the chosen blocks: as few as leave RUN
rows to a run, so runs are long and their number is what follows the rows. Over a run stands a tree: a node covers FAN nodes
below it and keeps the bits that all its members share. Pairs of nodes go down together; each level adds the differences in
the bits that became known there, and a pair with over D of them is dropped with all below it.

A run of up to PIECE rows is met in one task, many runs at a time. Longer runs are cut at Gray ranks into pieces,
and pairs of pieces, whose shared bits allow a link, are dealt out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_order, materialize
from tidemark.llm.components import components, spanning

BITS = 64
#: Rows of a piece: a task compares two of them at a time.
PIECE = 4096
#: Children of a node, and pairs of nodes that are opened at a time.
FAN, OPEN = 8, 1 << 14
#: Rows of a run on the mean of random fingerprints: the first bits of the leading blocks are a key only as far as this asks.
RUN = 2048
#: The same for word fingerprints, which lie close to those of all texts of their language; there whole blocks are the key, two at least.
WORD_RUN = 64

#: near-copies of texts: the search's bits on words, the shingles that decide, and their bits that may differ. At a
#: similarity of 0.8 (cosine 8/9) 256 bits differ in 38.8 on the mean, with a deviation of 5.7: two of those are allowed.
WORD_BITS, SHINGLE, SHINGLE_WORDS, SHINGLE_BITS = 6, 5, 4, 50

# The increments of a splitmix64 sequence, one for each further 64 bits, and its multipliers.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _parts(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z and the six white-space characters only


def _shingles(parts: list[bytes], words: int) -> list[bytes]:
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return [joined[a:b] for a, b in zip([0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist())]


def _majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The bits that are set in over half of the hashes, by weight."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64) if weights is None else weights[at : at + (1 << 16)] @ bits
    half = len(hashes) if weights is None else int(weights.sum())
    return int(np.packbits(2 * total > half, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """Majority of the XXH64 (seed 42) of the shingles; 0 without words."""
    import xxhash

    return _majority(np.array([xxhash.xxh64_intdigest(s, 42) for s in _shingles(_parts(text), words)], "<u8"))


def sketch(text: bytes | None) -> tuple[int, ...]:
    """A fingerprint of words, weighted by the root of their counts, and SHINGLE_WORDS of the distinct shingles.

    Few edits leave nearly all words, so near copies are near in the first; the others tell how alike the
    shingles are. All are 0 without words.
    """
    import xxhash

    parts = _parts(text)
    counts = Counter(parts)
    words = np.array([xxhash.xxh64_intdigest(w, 42) for w in counts], "<u8")
    out = [_majority(words, np.rint(1024 * np.sqrt(np.array(list(counts.values()), float))).astype(np.int64))]
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in set(_shingles(parts, SHINGLE))], "<u8")
    for k in range(SHINGLE_WORDS):
        x = hashes + np.uint64(STEP * (k + 1) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_A)
        x = (x ^ x >> np.uint64(27)) * np.uint64(MIX_B)
        out.append(_majority(x ^ x >> np.uint64(31)))
    return tuple(out)


def marked(docs: DataFrame, names: list[str], mark) -> DataFrame:
    """rid (a number for each row), the numbers that mark(text) gives as signed longs, and docs' columns as c0, c1 and so on.

    Written down. Numbered names can't clash with any others. A null text counts as empty.
    """
    kept = docs.columns
    inner = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("text").cast("binary").alias("bytes"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [mark(x) for at in range(0, batch.num_rows, 256) for x in batch.column(1).slice(at, 256).to_pylist()]
            made = np.array(got, np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(names))), *batch.columns[2:]], ["rid", *names, *batch.schema.names[2:]])

    schema = ", ".join(["rid long", *(f"{n} long" for n in names), *(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))])
    return materialize(inner.mapInArrow(run, schema), "fps", "zstd")


def layout(distance: int, n: int, run: int, least: int = 1) -> tuple[list[tuple[int, int]], int, int]:
    """(lowest bit, width) of the blocks, how many of them lead in a table, and how many first bits are the key, for n fingerprints.

    More blocks lead only where the whole of fewer would leave over `run` rows to a run (of one block: four times as many). least: blocks that lead at any size; from
    two on all their bits are the key.
    """
    for more in range(least, 5):
        m = distance + more
        whole = more * (BITS // m)
        if n >> whole <= (4 * run if least == 1 else run):
            break
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])], more, whole if least > 1 or not run else min(whole, (n // run).bit_length())


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: each bit is the parity of the bits above it and itself."""
    rank = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


def tables(reps: DataFrame, blocks: list[tuple[int, int]], more: int, key_bits: int) -> DataFrame:
    """reps for each table: t, key (the first key_bits of the Gray rank), gray (the whole one's) and reps' columns but fp, its first.

    A bit order of its own for each table leaves all distances as they are, and rank ^ (rank >>> 1) gives the bits back.
    """
    rest = reps.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            parts = [(fps >> np.uint64(low) & np.uint64((1 << width) - 1), width) for low, width in blocks]
            for t, chosen in enumerate(combinations(range(len(blocks)), more)):
                turned, at = np.zeros(len(fps), np.uint64), BITS
                for part, width in [parts[b] for b in chosen] + [x for b, x in enumerate(parts) if b not in chosen]:
                    at -= width
                    turned |= part << np.uint64(at)
                gray = gray_rank(turned)
                key = gray >> np.uint64(BITS - key_bits) if key_bits else np.zeros(len(fps), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int32)), pa.array(key.view(np.int64)), pa.array(gray.view(np.int64)), *batch.columns[1:]], ["t", "key", "gray", *rest])

    return reps.mapInArrow(run, ", ".join(["t int", "key long", "gray long", *(f"{c} long" for c in rest)]))


class Tree:
    """Nodes over runs of rows in Gray order. Level 0 are the rows; at the top every run has one node.

    first[k] says where the children of level k's nodes begin in the level below; ones and shared are a node's
    pattern and the bits that all below it have alike.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.ones, self.shared, self.first = [codes], [np.full(len(codes), ~np.uint64(0))], [np.zeros(0, np.int64)]
        sizes = np.diff(np.append(starts, len(codes)))
        any_ = codes
        while sizes.max() > 1:
            inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(inner % FAN == 0)
            ones, any_ = np.bitwise_and.reduceat(self.ones[-1], at), np.bitwise_or.reduceat(any_, at)
            self.first.append(np.append(at, len(inner)))
            self.ones.append(ones)
            self.shared.append(~(ones ^ any_))
            sizes = -(-sizes // FAN)

    def pairs(self, x: np.ndarray, y: np.ndarray, distance: int, tally: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j), i before j, within distance below the top nodes x and y; x <= y, and equal ones stand for a run with itself."""
        top = len(self.ones) - 1
        known = self.shared[top][x] & self.shared[top][y]
        apart = np.bitwise_count((self.ones[top][x] ^ self.ones[top][y]) & known).astype(np.int64)
        stack = [(top, x[at], y[at], known[at], apart[at]) for at in _slices(np.flatnonzero(apart <= distance))]
        while stack:
            level, x, y, known, apart = stack.pop()
            if level == 0:
                yield x, y
                continue
            first = self.first[level]
            many_x, many_y = first[x + 1] - first[x], first[y + 1] - first[y]
            many = many_x * many_y
            of = np.repeat(np.arange(len(x)), many)
            place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            i, j = first[x][of] + place // many_y[of], first[y][of] + place % many_y[of]
            keep = np.flatnonzero((x != y)[of] | (i < j if level == 1 else i <= j))
            i, j, of = i[keep], j[keep], of[keep]
            new = self.shared[level - 1][i] & self.shared[level - 1][j] & ~known[of]
            total = apart[of] + np.bitwise_count((self.ones[level - 1][i] ^ self.ones[level - 1][j]) & new)
            left = np.flatnonzero(total <= distance)
            if tally is not None:
                tally[level - 1, "met"] += len(total)
                tally[level - 1, "left"] += len(left)
            stack += [(level - 1, i[at], j[at], known[of[at]] | new[at], total[at]) for at in _slices(left)]


def _slices(at: np.ndarray) -> list[np.ndarray]:
    return [at[a : a + OPEN] for a in range(0, len(at), OPEN)]


def forest(codes: np.ndarray, checks: np.ndarray, starts: np.ndarray, x: np.ndarray, y: np.ndarray, distance: int, limit: int, tally: Counter | None = None) -> np.ndarray:
    """The root of each row under the links between the runs x and y of one tree (by place in starts; x <= y).

    A link has at most `distance` differing bits, and at most `limit` in the columns of checks, if there are any.
    """
    root = np.arange(len(codes))
    us, vs, held = [], [], 0

    def fold() -> None:
        nonlocal root, held
        if us:
            root = spanning(np.concatenate([*us, np.arange(len(root))]), np.concatenate([*vs, root]), len(root))
            us.clear(), vs.clear()
            held = 0

    for i, j in Tree(codes, starts).pairs(x, y, distance, tally):
        if checks.shape[1]:
            near = np.bitwise_count(checks[i] ^ checks[j]).sum(1, dtype=np.int64) <= limit
            i, j = i[near], j[near]
        us.append(i)
        vs.append(j)
        held += len(i)
        if held > 1 << 20:
            fold()
    fold()
    return root


def _search(distance: int, limit: int, checks: int):
    """Arrow batches sorted by t, key, a, b, side and gray to edges (u, v). Rows of one t, key, a and b fit in memory."""

    def whole(cols: list[np.ndarray]) -> pa.RecordBatch:
        group = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        run = np.flatnonzero(group | (cols[4][1:] != cols[4][:-1])) + 1
        starts = np.concatenate([[0], run])
        lone = np.concatenate([[True], group[run - 1]])  # a run that begins a group, else it is a group's other side
        gray, node = cols[5].view(np.uint64), cols[6]
        x = np.flatnonzero(lone)
        y = np.append(x[1:], len(starts)) - 1  # the group's last run: its other side, or itself
        sizes = np.diff(np.append(starts, len(gray)))
        some = (x != y) | (sizes[x] > 1)
        bits = np.ascontiguousarray(np.stack(cols[7:], 1)).view(np.uint64) if checks else np.zeros((len(gray), 0), np.uint64)
        root = forest(gray ^ gray >> np.uint64(1), bits, starts, x[some], y[some], distance, limit)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def joined() -> list[np.ndarray]:
            return [np.ascontiguousarray(np.concatenate(c)) for c in zip(*held)]

        for batch in batches:
            if batch.num_rows:
                held.append([np.asarray(c) for c in batch.columns])
            if sum(len(c[0]) for c in held) >= 4 * PIECE:
                cols = joined()
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
                cut = int(new[-1]) if len(new) else 0
                held = [[c[cut:] for c in cols]]
                if cut:
                    yield whole([c[:cut] for c in cols])
        if held:
            yield whole(joined())

    return run


def _pieces(long: DataFrame, rest: list[str], distance: int, piece: int) -> DataFrame:
    """Rows of long runs for each pair of pieces of their run that may link: t, key, a, b, side, gray and rest."""
    # Gray ranks are unsigned: with the sign bit turned, the signed order is theirs.
    placed = in_order(long.withColumn("up", F.col("gray").bitwiseXOR(F.lit(-(1 << 63)))), ["t", "up"], "gray")
    # A row for each long run and range partition that holds some of it.
    counts = placed.groupBy("t", "key", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("t", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("t", "key", "part", (before - F.col("first")).alias("shift"))
    number = F.floor((F.col("row") + F.col("shift")) / piece)
    cut = materialize(placed.join(counts, ["t", "key", "part"]).select("t", "key", "gray", *rest, number.alias("piece")), "pieces")
    bits = cut.select("t", "key", "piece", F.col("gray").bitwiseXOR(F.shiftrightunsigned("gray", 1)).alias("code"))
    nodes = bits.groupBy("t", "key", "piece").agg(F.expr("bit_and(code)").alias("ones"), F.expr("bit_or(code)").alias("any_"))
    nodes = nodes.select("t", "key", "piece", "ones", F.expr("~(ones ^ any_)").alias("shared"))
    right = nodes.select("t", "key", F.col("piece").alias("piece_b"), F.col("ones").alias("ones_b"), F.col("shared").alias("shared_b"))
    pairs = nodes.join(right, ["t", "key"]).where("piece <= piece_b").where(f"piece = piece_b OR bit_count((ones ^ ones_b) & shared & shared_b) <= {distance}")
    one, two = F.struct(F.col("piece"), F.lit(0).alias("side")), F.struct(F.col("piece_b").alias("piece"), F.lit(1).alias("side"))
    sides = F.explode(F.when(F.col("piece") == F.col("piece_b"), F.array(one)).otherwise(F.array(one, two)))
    wanted = pairs.select("t", "key", F.col("piece").alias("a"), F.col("piece_b").alias("b"), sides.alias("s")).select("t", "key", "a", "b", "s.piece", "s.side")
    return cut.join(wanted, ["t", "key", "piece"]).select("t", "key", "a", "b", "side", "gray", *rest)


def links(reps: DataFrame, distance: int, piece: int = PIECE, limit: int = 0, run: int | None = None, least: int = 1) -> DataFrame:
    """Edges (u, v) between nodes whose components are those of all links.

    reps has node and fp, then any columns of further bits. A link has at most `distance` differing bits in fp,
    and at most `limit` over the further bits, if there are any. run, least: as layout() takes them.
    """
    if not 0 <= distance <= 12:
        raise ValueError("distance must be from 0 to 12")
    rest = ["node", *(c for c in reps.columns if c not in ("node", "fp"))]
    n = reps.count()
    blocks, more, key_bits = layout(distance, n, RUN if run is None else run, least)
    rows = tables(reps.select("fp", *rest), blocks, more, key_bits)
    long = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > piece).select("t", "key"), "long")
    dealt = rows.join(long, ["t", "key"], "left_anti").select("t", "key", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side"), "gray", *rest)
    if not long.isEmpty():
        dealt = dealt.unionByName(_pieces(rows.join(long, ["t", "key"], "left_semi"), rest, distance, piece))
    order = ["t", "key", "a", "b", "side"]
    up = F.col("gray").bitwiseXOR(F.lit(-(1 << 63)))
    # Few bytes are much work here, so the number of parts follows the rows and isn't cut by their size.
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * math.comb(len(blocks), more) // (16 * PIECE))
    met = dealt.repartition(parts, "t", "key", "a", "b").sortWithinPartitions(*order, up)
    return met.mapInArrow(_search(distance, limit, len(rest) - 1), "u long, v long")


def spread(df: DataFrame, label: str) -> DataFrame:
    """df written in as many parts as there are cores twice, since few bytes here become many rows."""
    return materialize(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), label)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, piece: int = PIECE) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over links of at most `distance` bits.

    A null or empty text has fingerprint 0 and links like others, as do rows with a null doc_id; a component
    with null doc_ids only has a null component_id. Equal fingerprints are one node from the start, so copies never
    meet in pairs. Repeated rows stay, each with the same answer, and ties don't arise. Texts are read whole, 65,536
    shingles at a time. Other columns are not read, so their names can't clash. An empty table gives no rows.
    """
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fps = marked(inner, ["fp"], lambda x: (fingerprint(x, words),)).select(F.col("c0").alias("doc_id"), "fp")
    reps = spread(fps.select("fp").distinct(), "nodes").select(F.col("fp").alias("node"), "fp")
    roots = components(links(reps, distance, piece)).select(F.col("node").alias("fp"), "root")
    found = materialize(fps.join(roots, "fp", "left").withColumn("component", F.coalesce("root", "fp")).drop("root"), "classes")
    # Written down, so that the join stands on two plain exchanges and a hot component can be split.
    least = materialize(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(least, "component").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """docs with one row of each group of near copies: the least doc_id, and of rows that repeat it just one; nulls go last.

    Near copies are alike in five-word shingles: two rows link if their word fingerprints differ in at most WORD_BITS
    bits and the shingles' 256 bits in at most SHINGLE_BITS, which a similarity of 0.8 keeps but for its spread.
    Rows of equal sketches are one node. Null and empty texts are copies of each other. All columns stay, whatever their
    names; an empty table gives no rows.
    """
    bits = [f"s{k}" for k in range(SHINGLE_WORDS)]
    fps = marked(docs, ["fp", *bits], sketch)
    key = F.col(f"c{docs.columns.index('doc_id')}")
    best = F.min(F.struct(key.isNull().alias("none"), key.alias("id"), F.col("rid").alias("rid"))).alias("best")
    nodes = spread(fps.groupBy("fp", *bits).agg(best).withColumn("node", F.col("best.rid")), "nodes")
    roots = components(links(nodes.select("node", "fp", *bits), WORD_BITS, piece, SHINGLE_BITS, WORD_RUN, 2))
    least = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("component")).agg(F.min("best").alias("best"))
    kept = fps.join(least.select("best.rid"), "rid", "left_semi")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents, with four-word shingles and four bits; fingerprints as 16 hexadecimal digits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
