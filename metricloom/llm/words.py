"""Word arrays of whole texts in Arrow and numpy, for use inside tasks.

A word is a maximal run of characters outside ``\x20\x09-\x0D``. Splitting, hashing
and windows work on flat arrays over the documents of one Arrow batch, so there is
no Python code per word except for the hash of each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; longer batches are cut between documents.
SLICE_BYTES = 16 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one document at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield start, end
        start = end


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word number of each word, the distinct words, and where each text's words start (one more at the end).

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    starts = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    numbers, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if len(distinct) and (empty := pc.index(distinct, "").as_py()) >= 0:
        # Leading and trailing white space gives empty strings.
        real = numbers != empty
        kept = np.concatenate([[0], np.cumsum(real)])
        return numbers[real], distinct, kept[starts - starts[0]]
    return numbers, distinct, (starts - starts[0]).astype(np.int64)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads neighbouring inputs."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M2
    x = x ^ (x >> np.uint64(29))
    x = x * _M1
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of every ``width`` consecutive words of the flat array; windows across documents are the caller's to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, (seed * 0x9E3779B97F4A7C15 + width) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(width):
        acc = mix(acc * _M1 + hashes[i:i + n])
    return acc


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges ``starts[i] .. starts[i] + counts[i] - 1`` after one another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat word positions at which a window lies within one document, and that document's row."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    return spread(offsets[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def sums_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each document's range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
