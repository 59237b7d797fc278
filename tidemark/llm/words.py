"""Words of whole texts as Arrow arrays, cut by a table of bytes without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is worked on at a time; a longer text is worked on alone.
GROUP_BYTES = 4 << 20


#: What parts words `[^\x20\x09-\x0D]+`.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: What parts runs of letters: all ASCII but A-Z and a-z.
NO_LETTERS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def groups(batch: pa.RecordBatch, text: str, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, most + (sizes[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def split(texts: pa.Array, breaks: bytes, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words one after another, and how many each text has; a null text has none. Words are cut at the bytes of breaks."""
    texts = pc.fill_null(texts, "")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    parts = np.zeros(256, bool)
    parts[list(breaks)] = True
    keep = ~parts[data]
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    start[first] = keep[first]
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(start)])
    body = data[keep]
    if lower:
        body[(body >= 0x41) & (body <= 0x5A)] += 32
    offsets = np.append(np.flatnonzero(start[keep]), len(body)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    return words, before[bounds[1:]] - before[bounds[:-1]]


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the word of each number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
