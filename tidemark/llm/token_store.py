"""Token ids in directly addressable codes: any token can be read without decoding its neighbours.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a bitmap says whose ids
go on; level 1 holds the next chunk of just those, and so forth. A rank directory (ones before every
512th bit) turns a place in one level into the place in the next in constant time.

A store is a Parquet data set of segments: Spark's writer commits it on any file system, and a lost
executor only repeats its segments. The payload of each segment is the coded binary itself.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path

MAGIC = b"DAC1"
BLOCK = 512
END_ID = 2
#: A segment is closed at this many tokens; what was encoded with the last of them is in it too.
SEGMENT_TOKENS = 1 << 18
#: Words that a Python worker keeps encoded; at the bound the store starts anew, which costs time only.
STORE_WORDS = 500_000
#: Text encoded at a time.
CHUNK_BYTES = 4 << 20
# A mark behind a plain letter: the tokenizer's words end there anyway. Not those of contractions and special tokens.
MARKS = r"([a-z\x{e0}-\x{f6}\x{f8}-\x{ff}])([,.;:!?#*$%&()\[\]\"/=+@_-])"

SEGMENT = "part int, segment int, n_tokens long, doc_ids array<long>, offsets array<long>, payload binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """MAGIC, number of levels, then for each level: length, chunks, continuation bits, rank directory."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        levels.append(struct.pack("<QQQ", len(rest), len(bits), len(ranks)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u8").tobytes())
        if not goes_on.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[goes_on] >> np.uint64(8)


class DacReader:
    """Reads tokens of one segment by place; nothing is decoded ahead."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", payload, 4)[0]):
            n, bits, ranks = struct.unpack_from("<QQQ", payload, at)
            at += 24
            parts = []
            for kind, count, width in ((np.uint8, n, 1), (np.uint8, bits, 1), (np.dtype("<u8"), ranks, 8)):
                parts.append(np.frombuffer(payload, kind, count, at))
                at += count * width
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, place: int) -> int:
        _, bits, ranks = self.levels[level]
        block = place // BLOCK
        from_, to = block * (BLOCK // 8), place // 8
        ones = int(ranks[block]) + int(np.bitwise_count(bits[from_:to]).sum())
        return ones + int(bits[to] & ((1 << place % 8) - 1)).bit_count() if place % 8 else ones

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < len(self):
            raise IndexError(place)
        value, shift, level = 0, 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[place]) << shift
            if not bits[place // 8] >> (place % 8) & 1:
                return value
            place = self._rank(level, place)
            shift, level = shift + 8, level + 1

    def read(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The tokens from start to stop, by the same ranks, a run at a time."""
        chunks, bits, _ = self.levels[level]
        out = chunks[start:stop].astype(np.uint64)
        if start < stop:
            on = np.flatnonzero(np.unpackbits(bits[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start])
            if len(on):
                first = self._rank(level, start)
                out[on] |= self.read(first, first + len(on), level + 1) << np.uint64(8)
        return out


#: Texts on which an encoder must agree with the library before it is used.
PROBES = ["", " ", "a", "Word, WORD word.", "it's don't we'll", "x1 22 3x", "a-b_c (d) e/f", "\u00e9 \u00c9 \u65e5\u672c\u8a9e \U0001f600", "a\tb\nc  d\u00a0e", "...!?", "<|endoftext|> a"]


class WordEncoder:
    """A tokenizer whose words stand apart at white space, with the words it has met kept.

    For tokenizers that drop white space, lower the case and part letters from marks: the ids of a text
    are those of its words one after another, and `Word,` is `word` and `,`. So few distinct words are
    left; each goes through the library once, and its ids are gathered for every place it stands at.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.special = [s.content for s in self.t.get_added_tokens_decoder().values()]
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a run of letters
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self._forget()
        got, ends = self.encode(pa.array(PROBES))
        if [got[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] != [self.t.encode(x, add_special_tokens=False).ids for x in PROBES]:
            raise ValueError(f"{path}: this tokenizer's words don't stand apart at white space")

    def words(self, texts: pa.Array) -> pa.ListArray:
        low = pc.ascii_lower(texts)
        for s in self.special:  # a special token's string counts as it is written only
            low = pc.if_else(pc.match_substring(low, s), texts, low)
        return pc.ascii_split_whitespace(pc.replace_substring_regex(low, MARKS, r"\1 \2"))

    def _ids(self, words: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
        """The words in another order, their ids one after another, and how many each has, both in parts.

        The library takes many words in one text, parted by line ends. A word of letters makes one run,
        whose last id is marked; offsets tell whose the ids of others are.
        """
        order, ids, counts = [], [], []
        letters, other = [], []
        for w in words:
            (letters if w.isalpha() else other).append(w)
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for group, e in zip(groups, self.t.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            got = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(group):
                order += group
                ids.append(got)
                counts.append(np.diff(cuts, prepend=0))
            else:  # a letter that falls apart in lower case
                other += group
        groups = [other[i : i + 256] for i in range(0, len(other), 256)]
        for group, e in zip(groups, self.t.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False)):
            starts = np.cumsum([0] + [len(w) + 1 for w in group[:-1]])
            order += group
            ids.append(np.array(e.ids, "<u4"))
            counts.append(np.diff(np.searchsorted([x[0] for x in e.offsets], starts), append=len(e.ids)))
        return order, ids, counts

    def _learn(self, words: list[str]) -> None:
        order, ids, counts = self._ids(words)
        self.store.update(zip(order, range(len(self.count), len(self.count) + len(order))))
        count = np.concatenate([self.count, *counts])
        self.ids, self.count, self.first = np.concatenate([self.ids, *ids]), count, np.cumsum(count) - count

    def _forget(self) -> None:
        """Words of the store have places in count and first: how many ids, and where they begin in ids."""
        self.store: dict[str, int] = {}
        self.ids, self.count, self.first = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text ends in them. A null text is empty."""
        lists = self.words(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.store) > STORE_WORDS:
            self._forget()
        place = np.fromiter(map(self.store.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            some = [words[i] for i in new.tolist()]
            self._learn(some)
            place[new] = np.fromiter(map(self.store.get, some), np.int64, len(some))
        at = place[np.asarray(coded.indices)]
        each = self.count[at]
        to = np.cumsum(each)
        gathered = self.ids[np.repeat(self.first[at] - (to - each), each) + np.arange(int(each.sum()))]
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        return gathered, np.concatenate([[0], to])[offsets[1:]]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of about CHUNK_BYTES; a longer text is alone."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 16)
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES)))
        yield start, stop
        start = stop


_encoders: dict[str, WordEncoder] = {}


def write_store(docs: DataFrame, path: str, to: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Writes the ids of all texts, each with end_id behind it, in ascending doc_id order to the data set `to`.

    Null doc_ids come first, rows of one doc_id in any order; a null text is empty.
    One range exchange sorts the texts, with a salt so that a repeated doc_id spreads; encoding goes on
    inside its tasks, a segment at a time. A text of any length is whole inside one segment. Other columns are not read;
    an empty table gives an empty store.
    """
    sort = [F.col("doc_id").asc_nulls_first(), F.rand(9)]  # the sample that finds the ranges reads no text
    ordered = docs.select("doc_id", "text").repartitionByRange(*sort).sortWithinPartitions(*sort)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        segment, doc_ids, offsets, ids, n = 0, [], [0], [], 0

        def close() -> pa.RecordBatch:
            row = [[part], [segment], [n], [doc_ids], [offsets], [dac_encode(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "segment", "n_tokens", "doc_ids", "offsets", "payload"])

        for batch in batches:
            for start, stop in slices(batch.column(1)):
                got, ends = _encoders[path].encode(batch.column(1).slice(start, stop - start))
                ids.append(np.insert(got, ends, end_id))
                doc_ids += batch.column(0).slice(start, stop - start).to_pylist()
                offsets += (n + ends + np.arange(1, len(ends) + 1)).tolist()
                n = offsets[-1]
                if n >= segment_tokens:
                    yield close()
                    segment, doc_ids, offsets, ids, n = segment + 1, [], [0], [], 0
        if doc_ids:
            yield close()

    ordered.mapInArrow(run, SEGMENT).write.parquet(to)


def firsts(store: DataFrame) -> DataFrame:
    """part, segment and `first`: how many tokens lie before the segment.

    Sums go first inside a part, then over the parts, of which there are as many as the writer had tasks.
    """
    sizes = store.select("part", "segment", "n_tokens")
    before = (Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = sizes.select("part", "segment", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(*before)), F.lit(0)).alias("shift"))
    return inside.join(parts, "part").select("part", "segment", (F.col("base") + F.col("shift")).alias("first"))


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read by place from the store's segments.

    The payloads are read where they lie; only the documents' rows are joined to their segment's start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, segment, payload = (batch.column(k)[i].as_py() for k in (0, 1, 4))
                doc_ids, offsets = batch.column(2)[i].values, np.asarray(batch.column(3)[i].values)
                reader, n = DacReader(payload), len(doc_ids)
                crc = [zlib.crc32(reader.read(a, b).astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, segment, np.int32)), doc_ids, pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    ["part", "segment", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    store = spark.read.schema(SEGMENT).parquet(path)
    rows = store.select("part", "segment", "doc_ids", "offsets", "payload").mapInArrow(run, "part int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(firsts(store), ["part", "segment"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents to a store of the public word vocabulary and reads each back by its place."""
    import public_tokenizers

    to = scratch_path(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), to)
    return read_docs(spark, to)
