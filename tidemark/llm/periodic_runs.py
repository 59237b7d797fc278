"""Periodic runs: maximal stretches of words that repeat with some period.

For each period p the multiples of p are a grid; a run of two periods or more holds a point i of it with i + p in the
run too. How far the words from i and from i + p agree, to the right and to the left, is found for all (p, i) at once
by binary search over prefix hashes. Equal stretches found under several periods are one run with the least of them
(the others are its multiples). All runs are then compared word by word; should a hash have misled, names of
blocks of 1, 2, 4... words, which are exact, take the hashes' place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import apart
from tidemark.llm.words import SPACES, groups, numbered, split

#: A run has this many words at least.
LEAST = 12
#: Pairs (period, grid point) that are searched at a time.
PAIRS = 1 << 19
#: With so many pairs waiting they are searched when the period has doubled, so that runs found spare later pairs.
WAITING = 20_000

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class PrefixHashes:
    """Whether blocks of 2^k words at i and at j are equal, by hashes modulo 2^64: no equal blocks are ever told apart."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            self.powers = np.full(len(words) + 1, 0x5851F42D4C957F2D, np.uint64)
            self.powers[0] = 1
            self.powers = np.cumprod(self.powers, dtype=np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.powers[:-1], dtype=np.uint64)])

    def same(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, s = 1 << k, self.sums
        return (s[i + n] - s[i]) * self.powers[j - i] == s[j + n] - s[j]


class BlockNames:
    """The same without error: equal blocks of 2^k words have one name, made of the names of their halves."""

    def __init__(self, words: np.ndarray):
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]

    def same(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        while len(self.names) <= k:
            last, half = self.names[-1], 1 << len(self.names) - 1
            pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        return self.names[k][i] == self.names[k][j]


def agreement(same: Callable, i: np.ndarray, j: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i and from j on (back: before them) agree, room at most: steps of 1, 2, 4... words while they agree, then binary search."""
    got, tops = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)

    def step(active: np.ndarray, k: int) -> np.ndarray:
        active = active[got[active] + (1 << k) <= room[active]]
        move = -got[active] - (1 << k) if back else got[active]
        active = active[same(k, i[active] + move, j[active] + move)]
        got[active] += 1 << k
        return active

    active, k = np.arange(len(i)), 0
    while len(active):
        active = step(active, k)
        k += 1
        tops[active] = k
    for k in range(int(tops.max(initial=0)) - 1, -1, -1):
        step(np.flatnonzero(tops > k), k)
    return got


def _search(words: np.ndarray, longest: int, least: int, same: Callable) -> np.ndarray:
    """Rows (start, stop, period) of all stretches with two periods and `least` words or more, each once, by start and stop."""
    n, found, waiting, held, last = len(words), np.zeros((0, 3), np.int64), [], 0, 1
    inside, until = np.zeros(n, np.int64), np.zeros(n, np.int64)  # period and end of a run that holds the word

    def search(i: np.ndarray, p: np.ndarray) -> None:
        nonlocal found
        fresh = (inside[i] == 0) | (p % np.maximum(inside[i], 1) > 0) | (i + p >= until[i])
        i, p = i[fresh], p[fresh]
        ahead = agreement(same, i, i + p, n - i - p, False)
        behind = agreement(same, i, i + p, i, True)
        ok = (ahead + behind >= p) & (ahead + behind + p >= least)
        new = np.unique(np.stack([i - behind, i + p + ahead, p], 1)[ok], axis=0)  # by start, stop, then period
        found = np.unique(np.concatenate([found, new]), axis=0)
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))] if len(found) else found
        for a, b, q in new[np.argsort(new[:, 1] - new[:, 0], kind="stable")]:
            if b - a >= 4 * least and b - a > until[a] - a:
                inside[a:b], until[a:b] = q, b

    def flush() -> None:
        nonlocal waiting, held
        i, p = (np.concatenate(x) for x in zip(*waiting))
        for at in range(0, len(i), PAIRS):
            search(i[at : at + PAIRS], p[at : at + PAIRS])
        waiting, held = [], 0

    for p in range(1, longest // 2 + 1):
        points = np.flatnonzero(words[: n - p : p] == words[p::p]) * p  # a run agrees at its grid point, so others need no search
        if len(points):
            waiting.append((points, np.full(len(points), p)))
            held += len(points)
        if held >= PAIRS or held >= WAITING and p >= 2 * last:
            flush()
            last = p
    if held:
        flush()
    return found


def _verified(words: np.ndarray, runs: np.ndarray) -> bool:
    """Whether each run repeats word by word and stops where the words stop repeating."""
    at = 0
    sizes = runs[:, 1] - runs[:, 0] - runs[:, 2]
    ends = np.cumsum(sizes)
    while at < len(runs):
        to = max(at + 1, int(np.searchsorted(ends, 4 * PAIRS + (ends[at - 1] if at else 0), "right")))
        s, z, p = runs[at:to, 0], sizes[at:to], runs[at:to, 2]
        i = np.arange(z.sum()) + np.repeat(s - np.cumsum(z) + z, z)
        if (words[i] != words[i + np.repeat(p, z)]).any():
            return False
        at = to
    left, right = runs[runs[:, 0] > 0], runs[runs[:, 1] < len(words)]
    return bool((words[left[:, 0] - 1] != words[left[:, 0] + left[:, 2] - 1]).all() and (words[right[:, 1]] != words[right[:, 1] - right[:, 2]]).all())


def maximal_runs(words: np.ndarray, longest: int | None = None, least: int = LEAST) -> np.ndarray:
    """Rows (start, stop, period) of all maximal runs of an array of word numbers, by start and stop. longest: no run is longer."""
    longest = len(words) if longest is None else longest
    for kind in (PrefixHashes, BlockNames):
        runs = _search(words, longest, least, kind(words).same)
        if _verified(words, runs):
            return runs
    raise AssertionError("runs that don't repeat")


def runs_of_texts(ids: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Text number and (start, length, period) of the runs of many texts, by text, start and period.

    ids: the words of all texts. Texts of like length are searched as one array, with a word of its own between any two.
    """
    starts, all_runs, all_texts = np.cumsum(counts) - counts, [], []
    classes = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for c in np.unique(classes[counts >= least]):
        texts = np.flatnonzero((classes == c) & (counts >= least))
        size = counts[texts]
        at = np.cumsum(size + 1) - size - 1  # where each text begins in the array
        words = np.zeros(int((size + 1).sum()), np.int64)
        words[at + size] = -1 - np.arange(len(texts))
        words[np.arange(size.sum()) + np.repeat(at - np.cumsum(size) + size, size)] = ids[np.arange(size.sum()) + np.repeat(starts[texts] - np.cumsum(size) + size, size)]
        runs = maximal_runs(words, int(size.max()), least)
        own = np.searchsorted(at, runs[:, 0], "right") - 1
        all_texts.append(texts[own])
        all_runs.append(np.stack([runs[:, 0] - at[own], runs[:, 1] - runs[:, 0], runs[:, 2]], 1))
    if not all_runs:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    texts, runs = np.concatenate(all_texts), np.concatenate(all_runs)
    order = np.lexsort((runs[:, 2], runs[:, 0], texts))
    return texts[order], runs[order]


def periodic_runs(df: DataFrame, text: str, keep: Sequence[str] = (), least: int = LEAST, tail: Callable | None = None, key: str | None = None) -> DataFrame:
    """Columns *keep, n_words, runs (start, length and period in words, by start, then period) and collapsed, for each row of df.

    collapsed: the words that no run holds behind its first period, joined by a space. tail: a function of key's value and
    the number of words that gives None or (a, p); then from word a on the words before a + p repeat (a drill).
    A null or empty text has no words and no runs. Repeated rows are worked on one by one. A text of any length is searched
    as a whole, in memory of some 200 bytes a word; short ones are searched many at a time. Carried columns named like a result's
    get an underscore.
    """
    own = ["n_words", "runs", "collapsed"]
    shown = apart(keep, own)
    names = [f"c{i}" for i in range(len(keep))]
    put = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), (F.col(f"`{key}`") if key else F.lit(None).cast("long")).alias("k"), F.col(f"`{text}`").alias("t"))
    kinds = ", ".join(f"{n} {put.schema[n].dataType.simpleString()}" for n in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "t"):
                words, counts = split(part["t"], SPACES)
                ids, listed = numbered(words)
                starts = np.cumsum(counts) - counts
                if tail:
                    for k, n, s in zip(part["k"].to_pylist(), counts.tolist(), starts.tolist()):
                        if (planted := tail(k, n)) is not None:
                            a, p = planted
                            ids[s + a : s + n] = ids[s + a : s + a + p][np.arange(n - a) % p]
                texts, runs = runs_of_texts(ids, counts, least)
                marks = np.zeros(len(ids) + 1, np.int64)
                np.add.at(marks, starts[texts] + runs[:, 0] + runs[:, 2], 1)
                np.add.at(marks, starts[texts] + runs[:, 0] + runs[:, 1], -1)
                stays = np.cumsum(marks[:-1]) == 0
                bounds = np.append(0, np.cumsum(counts))
                left = np.append(0, np.cumsum(stays))[bounds].astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(left), listed.cast(pa.string()).take(pa.array(ids[stays])))
                ends = np.append(0, np.cumsum(np.bincount(texts, minlength=len(counts)))).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(runs[:, x]) for x in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*(part[n] for n in names), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), spans), pc.binary_join(kept, " ")],
                    [*names, *own],
                )

    out = put.mapInArrow(work, (kinds + ", " if kinds else "") + f"n_words bigint, runs {RUNS}, collapsed string")
    return out.select(*(F.col(n).alias(s) for n, s in zip(names, shown)), *own)


def _drill(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The planted repetition of one text in ten."""
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, one in ten of them with a planted repetition; a null doc_id has none planted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, "text", ["doc_id"], tail=_drill, key="doc_id")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", listed), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
