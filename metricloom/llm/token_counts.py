"""Token counts of whole texts; huge texts in overlapping chunks that are spliced where both agree.

A text of over ``chunk_chars`` characters is encoded in chunks that overlap. Two
neighbouring chunks are spliced at a character position that

* ends a word: a non-space character before it, an ASCII space or line end at it;
* is a token border in both encodings, with the same tokens on both sides of it.

No pre-tokenizer of the supported kinds matches across the first property, so what
is left of the position does not depend on text right of it, and the other way
round. Where the overlap holds no such position, the second chunk begins further
left, at twice the overlap; once it begins at the last splice, the two are one
chunk, and in the end one chunk holds the text.

Defined results: null text counts as empty (0 bytes, 0 tokens). Rows are counted one
by one, so repeated rows and null ids give a row each. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from metricloom.llm.encoding import text_encoder
from metricloom.llm.words import as_array, slices

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_SPACES = " \n\t\r"


class Chunk:
    """The tokens of ``text[start:end]`` with their borders as positions of the whole text."""

    def __init__(self, tokenizer: Tokenizer, text: str, start: int, end: int):
        encoding = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end = start, end
        self.ids = np.array(encoding.ids, np.int64)
        borders = np.array(encoding.offsets, np.int64).reshape(-1, 2) + start
        self.left, self.right = borders[:, 0], borders[:, 1]

    def count(self, low: int, high: int) -> int:
        """Tokens that begin in [low, high)."""
        return int(np.count_nonzero((self.left >= low) & (self.left < high)))

    def around(self, p: int) -> tuple | None:
        """The tokens before and after ``p``; None if one lies across it or is missing."""
        after = int(np.searchsorted(self.left, p))
        if after == 0 or after == len(self.ids) or self.right[after - 1] > p:
            return None
        pick = slice(after - 1, after + 1)
        return tuple(zip(self.ids[pick].tolist(), self.left[pick].tolist(), self.right[pick].tolist(), strict=True))


def splice_point(text: str, a: Chunk, b: Chunk) -> int | None:
    """The stable common border nearest to the middle of the overlap, if there is one."""
    low, high = b.start + 1, a.end - 1
    ends = (p for p in range(low, high) if text[p] in _SPACES and not text[p - 1].isspace())
    middle = (low + high) // 2
    for p in sorted(ends, key=lambda p: abs(p - middle)):
        here = a.around(p)
        if here is not None and here == b.around(p):
            return p
    return None


def count_in_chunks(tokenizer: Tokenizer, text: str, chunk_chars: int = CHUNK_CHARS,
                    overlap_chars: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` as one call would give them, holding one or two chunks at a time."""
    if overlap_chars < 1 or chunk_chars <= 2 * overlap_chars:
        raise ValueError("a chunk must be longer than two overlaps, and an overlap positive")
    total, done = 0, 0
    a = Chunk(tokenizer, text, 0, min(chunk_chars, len(text)))
    while a.end < len(text):
        overlap, end = overlap_chars, min(a.end + chunk_chars, len(text))
        while True:
            start = max(done, a.end - overlap)
            if start == done:
                # No agreement anywhere: the two chunks are one.
                a = Chunk(tokenizer, text, done, end)
                break
            b = Chunk(tokenizer, text, start, end)
            p = splice_point(text, a, b)
            if p is not None:
                total += a.count(done, p)
                a, done = b, p
                break
            overlap *= 2
    return total + a.count(done, len(text) + 1)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 2048,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row; one pass over the texts, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        # Chunks are taken apart at word ends, which only holds for tokenizers that part words there.
        chunked = encoder.by_word
        for batch in batches:
            for a, b in slices(as_array(batch.column(1))):
                part = batch.slice(a, b - a)
                texts = pc.fill_null(part.column(1), "")
                huge = pc.greater(pc.utf8_length(texts), chunk_chars) if chunked else pa.array([False] * len(texts))
                counts = encoder.counts(pc.if_else(huge, "", texts))
                for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)):
                    counts[i] = count_in_chunks(encoder.tokenizer, texts[i].as_py(), chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(counts > limit),
                ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(count, SCHEMA)
