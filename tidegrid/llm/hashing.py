"""Words of whole texts as numbers: Arrow splits and numbers them, numpy combines them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Texts of about so many bytes are worked on at once; a longer text comes alone.
SLICE_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of bounded text size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _ODD[0]
    x ^= x >> np.uint64(27)
    x *= _ODD[1]
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each text's words (n + 1 numbers), and all words in order.

    Words are runs without ASCII white space; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words = lists.values
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = words.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return kept[offsets].astype(np.int64), words.filter(full)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as the rows of a 2 x n array."""
    if len(words) == 0:
        return np.zeros((2, 0), np.uint64)
    coded = words.dictionary_encode()
    digests = b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()])
    table = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    return table.T[:, coded.indices.to_numpy()]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values, by doubling; length n - k + 1 (or 0).

    Windows that cross a text's end are for the caller to leave out.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size, base = hashes, 1, int(_STEP)
    done, done_size = None, 0
    while True:
        if k & size:
            if done is None:
                done, done_size = run, size
            else:
                m = min(len(done), len(run) - done_size)
                done = done[:m] * np.uint64(pow(base, size, 1 << 64)) + run[done_size : done_size + m]
                done_size += size
        if done_size == k:
            return mixed(done[:n])
        run = run[:-size] * np.uint64(pow(base, size, 1 << 64)) + run[size:]
        size *= 2


def within(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of ``n`` window starts, whether its ``k`` words lie in one text."""
    inside = np.zeros(n + 1, np.int32)
    begins, ends = bounds[:-1], bounds[1:] - k + 1
    some = ends > begins
    np.add.at(inside, begins[some], 1)
    np.add.at(inside, ends[some], -1)
    return np.cumsum(inside[:n]) > 0


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
