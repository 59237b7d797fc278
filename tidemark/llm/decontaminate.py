"""Benchmark decontamination by the q-gram lemma in diagonal bands, then banded alignment.

An item of m characters within e edits of a stretch of text keeps at least m - q + 1 - q*e of its q-grams
there, and all on diagonals (place in text less place in item) that span at most e. So with bands of
width 2(e + 1) that start every e + 1 diagonals, some band holds them all. Bands with fewer shared
q-grams can't hold a match; the others are aligned inside the band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Characters in a q-gram, and the share of an item's characters that may differ.
Q, EDITS = 8, 0.1
#: Items go to the tasks in blocks of at most this many bytes of text; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20
#: Characters of text looked up at a time, and places in items that they may meet at a time.
CHUNK, POSTINGS = 1 << 20, 1 << 20

_MIX = 0x9E3779B97F4A7C15
_table: np.ndarray | None = None


def character_table() -> np.ndarray:
    """By code point: 0 for what is no letter or digit, else its lower-case code point (the first, of several)."""
    global _table
    if _table is None:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalnum():
                table[cp] = ord(ch.lower()[0])
        _table = table
    return _table


def normalise(text: str) -> np.ndarray:
    """Letters and digits in lower case, everything between them one 0; none at the ends."""
    codes = character_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    out = codes[keep]
    return out[: len(out) - 1] if len(out) and out[-1] == 0 else out


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each q-gram; equal q-grams have equal keys."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    keys, wide = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for k in range(Q):
        keys *= np.uint64(_MIX)
        keys += wide[k : k + n]
    return keys ^ keys >> np.uint64(29)


def budget(m: int) -> int:
    """Edits allowed for an item of m characters: a tenth, or fewer where the lemma would ask for no q-gram."""
    return max(0, min(int(m * EDITS), (m - Q) // Q))


@dataclass
class Index:
    """Postings of the items' q-grams, sorted by key."""

    codes: list[np.ndarray]
    ids: list[list[int]]
    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    maybe: np.ndarray
    short: dict[bytes, list[int]]


def index(rows: list[tuple[int, str | None]]) -> Index:
    """Items with equal normalised text share one entry. Items of under Q characters need their whole text as words."""
    by_text: dict[bytes, list[int]] = {}
    for item_id, text in rows:
        codes = normalise(text or "")
        if len(codes):
            by_text.setdefault(codes.tobytes(), []).append(item_id)
    short = {k: v for k, v in by_text.items() if len(k) < 4 * Q}
    long = [(np.frombuffer(k, np.uint32), v) for k, v in by_text.items() if len(k) >= 4 * Q]
    codes = [c for c, _ in long]
    all_keys = [grams(c) for c in codes]
    key = np.concatenate([np.zeros(0, np.uint64), *all_keys])
    item = np.repeat(np.arange(len(codes)), [len(k) for k in all_keys])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(k)) for k in all_keys)])
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    lengths = np.array([len(c) for c in codes], np.int64)
    edits = np.array([budget(m) for m in lengths], np.int64)
    maybe = np.zeros(1 << 22, bool)
    maybe[keys & np.uint64((1 << 22) - 1)] = True
    return Index(codes, [v for _, v in long], keys, np.append(starts, len(key)), item[order], place[order].astype(np.int64), edits, np.maximum(1, lengths - Q + 1 - Q * edits), maybe, short)


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> bool:
    """Whether the whole item is within `edits` of some stretch of text, on diagonals from low to high."""
    for d in range(max(low, 0), min(high, len(text) - len(item)) + 1):
        if (text[d : d + len(item)] == item).all():
            return True
    if not edits:
        return False
    low, high = low - edits, high + edits
    width, far = high - low + 1, len(item) + edits + 1
    steps = np.arange(width)
    padded = np.concatenate([np.full(max(0, -low), 0xFFFFFFFF, np.uint32), text[max(0, low) : max(0, high + len(item))]])
    padded = np.concatenate([padded, np.full(max(0, width + len(item) - len(padded)), 0xFFFFFFFF, np.uint32)])
    cost = np.zeros(width, np.int64)
    for j, ch in enumerate(item):
        same = cost + (padded[j : j + width] != ch)
        skip = np.append(cost[1:], far) + 1
        cost = np.minimum(same, skip)
        cost = np.minimum.accumulate(cost - steps) + steps
        if cost.min() > edits:
            return False
    return True


def _met(at: np.ndarray, found: np.ndarray, ix: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, place in the item, diagonal) of the postings of hits, POSTINGS or so at a time."""
    n = ix.starts[found + 1] - ix.starts[found]
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + POSTINGS, "right")))
        own = n[a:b]
        post = np.arange(int(own.sum())) + np.repeat(ix.starts[found[a:b]] - np.concatenate([[0], np.cumsum(own)[:-1]]), own)
        yield ix.item[post], ix.place[post], np.repeat(at[a:b], own) - ix.place[post]
        a = b


def candidates(keys: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int]]:
    """(item, lowest diagonal, highest diagonal) of the bands of one stretch of keys that meet the bound.

    Postings of frequent q-grams are counted in slices, so memory follows the bands that are hit, not the hits.
    """
    at = np.flatnonzero(ix.maybe[keys & np.uint64((1 << 22) - 1)])
    if not len(at):
        return
    found = np.searchsorted(ix.keys, keys[at])
    found[found == len(ix.keys)] = 0
    hit = ix.keys[found] == keys[at]
    at, found = at[hit], found[hit]
    if not len(at):
        return
    # Bands of an item begin every edits + 1 diagonals; numbers of bands start at 0 at the lowest diagonal that can be.
    low = -int(ix.place.max()) - 2
    span = len(keys) - low + 2

    def bands(item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        # A diagonal lies in the band that starts at its own step and in the one before.
        return item * span + (diagonal - low) // (ix.edits[item] + 1)

    own = None
    for item, _, diagonal in _met(at, found, ix):
        one, n = np.unique(bands(item, diagonal), return_counts=True)
        if own is None:
            own, counts = one, n
        else:
            own, where = np.unique(np.concatenate([own, one]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(own)).astype(np.int64)
    both, where = np.unique(np.concatenate([own, own - 1]), return_inverse=True)
    total = np.bincount(where, np.concatenate([counts, counts]), len(both))
    passed = both[total >= ix.need[both // span]]
    if not len(passed):
        return
    # Repeated text meets one place of an item many times; the lemma counts the place once.
    pairs = np.zeros((0, 2), np.int64)
    for item, place, diagonal in _met(at, found, ix):
        band = bands(item, diagonal)
        some = [np.stack([(band - by)[k], place[k]], 1) for by in (0, 1) for k in [np.isin(band - by, passed)]]
        pairs = np.unique(np.concatenate([pairs, *some]), axis=0)
    passed, distinct = np.unique(pairs[:, 0], return_counts=True)
    for code in passed[distinct >= ix.need[passed // span]]:
        k, step = int(code // span), int(ix.edits[code // span] + 1)
        first = int(code % span) * step + low
        yield k, first, first + 2 * step - 1


def matches(text: str | None, ix: Index) -> list[int]:
    """Sorted ids of the items that the whole text holds."""
    codes = normalise(text or "")
    hits: set[int] = set()
    if ix.short and len(codes):
        around = np.concatenate([[0], codes, [0]]).astype(np.uint32).tobytes()
        for raw, ids in ix.short.items():
            want, at = b"\0\0\0\0" + raw + b"\0\0\0\0", -1
            while (at := around.find(want, at + 1)) >= 0:
                if at % 4 == 0:
                    hits.update(ids)
                    break
    if len(ix.keys):
        keys, done = grams(codes), set()
        longest = max(len(c) for c in ix.codes)
        # Stretches overlap by the longest item and its edits, so that no match is cut.
        lap = 2 * longest
        for start in range(0, max(1, len(keys)), CHUNK):
            for k, low, high in candidates(keys[start : start + CHUNK + lap], ix):
                if k not in done and aligned(ix.codes[k], codes, low + start, high + start, int(ix.edits[k])):
                    done.add(k)
                    hits.update(ix.ids[k])
    return sorted(hits)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of BLOCK_BYTES or so, of which the driver holds the one that it gives."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    dealt = benchmark.where("item_id IS NOT NULL").select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"))
    for b in range(n):
        yield [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == b).collect()]


def _found(ix_rows: list[tuple[int, str | None]]):
    """Batches whose last column is the text to the same with the ids of its items in the text's place."""
    held: dict[str, Index] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "ix" not in held:
            held["ix"] = index(ix_rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = pa.array([matches(x, held["ix"]) for x in some.column(some.num_columns - 1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], found], [*some.schema.names[:-1], "items"])

    return run


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rid and item of each item that a text holds, from docs' rid and text.

    A stated set of items meets all texts, block by block: each block is one pass over the texts that writes its
    hits down before the next block is read, so a task holds one index at a time and texts are never shuffled.
    """
    out = None
    for rows in blocks(benchmark):
        found = docs.select("rid", "text").mapInArrow(_found(rows), "rid long, items array<long>")
        found = materialize(found.select("rid", F.explode("items").alias("item")), "hits")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs' columns as c0, c1 and so on with rid, a number for each row; and rid with items, the sorted ids of what it holds.

    Rows that hold nothing are absent from the second. A null or empty text holds none; items without letters or
    digits, or without an id, match nothing. Repeated items count once for each id, repeated rows each for themselves.
    Texts are read whole, CHUNK characters at a time; no name of a column can clash. Empty tables give empty frames.
    """
    named = docs.select(F.monotonically_increasing_id().alias("rid"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    numbered = materialize(named, "numbered", "zstd")
    met = hits(numbered.select("rid", F.col(f"c{docs.columns.index('text')}").alias("text")), benchmark)
    return numbered, met.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with docs' columns; items without an id count too."""
    numbered, met = contamination(docs, benchmark.select(F.monotonically_increasing_id().alias("item_id"), "text"))
    return numbered.join(met, "rid", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every document, the sorted ids of the benchmark items in its text, and whether there are any."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    numbered, met = contamination(docs.select("doc_id", "text"), items)
    out = numbered.select("rid", F.col("c0").alias("doc_id")).join(met, "rid", "left")
    return out.select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("item_ids"), F.col("items").isNotNull().alias("contaminated"))
