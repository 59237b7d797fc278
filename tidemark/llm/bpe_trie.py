"""BPE encoding over a trie of words, and decoding.

The last token of a prefix's encoding decides the whole encoding: drop that token and the shorter
prefix's last token comes next. So a trie of words needs one state (a last token) at each node, and
words that share a prefix share its states. A node's last token is the one vocabulary token that ends
there and that BPE would leave beside the last token of the prefix before it.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import apart

#: Fixed value: the published byte-level pattern that parts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that a Python worker keeps encoded; at the bound the store starts anew, which costs time only.
STORE_WORDS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTrie:
    """Encodes sets of words by one depth-first walk over their trie."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.longest = max(map(len, self.id_of))
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = vocab[a], vocab[b]
            self.rank[left, right] = rank
            made.setdefault(vocab[a + b], (left, right, rank))
        self.left_edge: dict[int, list[tuple[int, float]]] = {}
        self.right_edge: dict[int, list[tuple[int, float]]] = {}
        for i in vocab.values():
            self.left_edge[i], self.right_edge[i] = self._edge(i, made, 0), self._edge(i, made, 1)
        self.fits: dict[int, bool] = {}
        self.store: dict[str, bytes] = {}
        self.special_parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)

    @staticmethod
    def _edge(token: int, made: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, float]]:
        """The pieces at one edge of a token while it is merged, each with the rank at which it is taken up."""
        out, taken = [], float("inf")
        while True:
            out.append((token, taken))
            if token not in made:
                return out
            taken = made[token][2]
            token = made[token][side]

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart: no merge over the border comes before the pieces' own.

        Of equal ranks the leftmost goes first, so the left token's own merge wins a tie and the right one's loses it.
        """
        rank = self.rank
        known = not any((r := rank.get((a, b))) is not None and r < until and r <= before for a, until in self.right_edge[left] for b, before in self.left_edge[right])
        if len(self.fits) > 4_000_000:
            self.fits.clear()
        self.fits[left << 32 | right] = known
        return known

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Word -> ids as little-endian unsigned 32-bit integers.

        The sorted words are the trie's leaves in depth-first order: what a word shares with the one
        before it is the path that stays on the stack, and only the nodes below it get new states.
        """
        out: dict[str, bytes] = {}
        last: list[int] = [-1]  # by depth: the last token of the prefix
        size: list[int] = [0]  # and its length in bytes
        before = b""
        id_of, beside, longest, fits = self.id_of, self.beside, self.longest, self.fits
        for raw, word in sorted((w.encode(), w) for w in words):
            n, shared = len(raw), 0
            stop = min(n, len(before))
            while shared < stop and raw[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):  # only one token fits; most are short
                    token = id_of.get(raw[start:end])
                    if token is None:
                        continue
                    if start:
                        known = fits.get(last[start] << 32 | token)
                        if known is False or known is None and not beside(last[start], token):
                            continue
                    last.append(token)
                    size.append(end - start)
                    break
            before = raw
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text in order; special tokens' strings stand alone."""
        if self.special_parts is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.special_parts.split(text):
            out += [part] if part in self.special else self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        store = self.store
        new = {w for p in parts for w in p if w not in store}
        if len(store) + len(new) > STORE_WORDS:
            store.clear()
            new = {w for p in parts for w in p}
        for s in self.special:
            if s in new:
                new.discard(s)
                store[s] = array("I", [self.special[s]]).tobytes()
        store.update(self.encode_words(new))
        return [b"".join([store[w] for w in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        got = array("I")
        got.frombytes(ids)
        of = self.bytes_of
        return b"".join([of[i] for i in got]).decode("utf-8", "replace")


_tries: dict[str, WordTrie] = {}


def trie(path: str) -> WordTrie:
    """One for each Python worker."""
    if path not in _tries:
        _tries[path] = WordTrie(path)
    return _tries[path]


def encode_docs(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs' columns but text, then the ids (little-endian unsigned 32-bit, binary) and what they decode to.

    A null text counts as empty: no ids. Every row is encoded by itself and whole, so repeated rows give repeated
    results, and an empty table gives none. A column of docs named like `ids` or `decoded` gets an underscore.
    path: a tokenizer file that every executor can open.
    """
    kept = [c for c in docs.columns if c != text]
    shown = apart(kept, [ids, decoded])
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                coded = t.encode([x or "" for x in part.column(len(kept)).to_pylist()])
                back = [t.decode(x) for x in coded]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(coded, pa.binary()), pa.array(back, pa.string())], [*part.schema.names[: len(kept)], "ids", "decoded"])

    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "ids binary", "decoded string"])
    return inner.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(shown)), F.col("ids").alias(ids), F.col("decoded").alias(decoded))


def digest_docs(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests are taken where the ids are made, so no ids leave the task.

    Null and empty texts have no tokens. Rows go by themselves and texts whole; null doc_ids and repeated rows stay, other
    columns are not read, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(path)
        for batch in batches:
            texts, n, ids, back = batch.column(1), [], [], []
            for at in range(0, batch.num_rows, 128):
                for coded in t.encode([x or "" for x in texts.slice(at, 128).to_pylist()]):
                    n.append(len(coded) // 4)
                    ids.append(hashlib.sha256(coded).hexdigest())
                    back.append(hashlib.sha256(t.decode(coded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest_docs() of all documents with the public byte-level vocabulary."""
    return digest_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
