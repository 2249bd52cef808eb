"""Encoding and decoding of whole texts with byte-level BPE, merges in batched numpy rounds.

Texts are cut into pre-tokens by the byte-level pattern, distinct pre-tokens go through
``bpe.Vocabulary.encode`` together, and their ids are copied to every place. Where a
text's white space is single spaces and line ends only, its pre-tokens are those of
its words with the character before each, so the pattern runs once for each distinct
word; other texts are scanned as they are.

Defined results: null text is empty (no ids, the hash of no bytes). Rows are encoded
one by one, so repeated rows and null ids give a row each. Special tokens' strings in
a text become their ids, as the library does by default. Other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from metricloom.llm.bpe import Vocabulary
from metricloom.llm.encoding import strings
from metricloom.llm.words import as_array, slices, spread, sums_of

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is not one space or line end between two words.
UNEVEN = (r"^[ \n]|[ \n][ \n]|[ \n]$|[\t\r\x0b\x0c\x1c-\x1f]|\x{85}|\x{a0}|\x{1680}|[\x{2000}-\x{200a}]|\x{2028}|\x{2029}"
          r"|\x{202f}|\x{205f}|\x{3000}")
CACHE_WORDS = 400_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.vocabulary.special)) or r"(?!)")
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where the ids of each word (with the white space before it) are kept; new words are encoded together."""
        known = self.known
        missing = list(dict.fromkeys(w for w in words if w not in known))
        if missing:
            parts = list(map(self.pattern.findall, missing))
            flat = [p for x in parts for p in x]
            codes, distinct = _distinct(flat)
            ids, counts = self.vocabulary.encode([p.encode() for p in distinct])
            starts = np.cumsum(counts) - counts
            each = counts[codes]
            of_word = sums_of(each, np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]))
            for w in missing:
                known[w] = len(known)
            self.flat = np.concatenate([self.flat, ids[spread(starts[codes], each)]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(of_word)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _trim(self) -> None:
        """Forget the newest words beyond the cache size; the oldest are the frequent ones."""
        while len(self.known) > CACHE_WORDS:
            self.known.popitem()
        self.ends = self.ends[:len(self.known) + 1]
        self.flat = self.flat[:self.ends[-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and where each text's ids start (one more at the end)."""
        self._trim()
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for content in self.vocabulary.special:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        even = ~uneven & ~special
        owners, slots = [], []
        if even.any():
            # A line end starts the word after it, a space is put back in front of its word below.
            spaced = pc.replace_substring(texts.filter(pa.array(even)), "\n", " \n")
            lists = pc.split_pattern(spaced, " ")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            numbers, distinct = coded.indices.to_numpy(zero_copy_only=False), strings(coded.dictionary)
            own = [w if w[:1] == "\n" else " " + w for w in distinct]
            first, first_numbers = offsets[:-1], numbers[offsets[:-1]]
            seen, at = np.unique(first_numbers, return_inverse=True)
            where = self._slots(own + [distinct[i] for i in seen])
            slot = where[numbers]
            slot[first] = where[len(own) + at]
            owners.append(np.repeat(np.flatnonzero(even), np.diff(offsets)))
            slots.append(slot)
        for i in np.flatnonzero(~even):
            slot, last, text = [], 0, texts[i].as_py()
            for m in self.special.finditer(text):
                slot += [*self._slots(self.pattern.findall(text[last:m.start()])), -1 - self.vocabulary.special[m[0]]]
                last = m.end()
            slot += [*self._slots(self.pattern.findall(text[last:]))]
            owners.append(np.full(len(slot), i))
            slots.append(np.array(slot, np.int64))
        slot, owner = np.concatenate([*slots, np.zeros(0, np.int64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        slot, owner = slot[order], owner[order]
        flat = np.concatenate([self.flat, np.arange(self.vocabulary.size, dtype=np.int32)])
        plain = slot >= 0
        if plain.any():
            known = np.maximum(slot, 0)
            starts = np.where(plain, self.ends[known], len(self.flat) - 1 - slot)
            counts = np.where(plain, np.diff(self.ends)[known], 1)
        else:
            starts, counts = len(self.flat) - 1 - slot, np.ones(len(slot), np.int64)
        ids = flat[spread(starts, counts)]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64))])
        return ids, ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        return self.vocabulary.decode(ids, ends)


def _distinct(values: list[str]) -> tuple[np.ndarray, list[str]]:
    coded = pa.array(values, pa.string()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), strings(coded.dictionary)


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        decimal = np.array([str(i) for i in range(c.vocabulary.size)], object)
        for batch in batches:
            for a, b in slices(as_array(batch.column(1)), 4 << 20):
                part = batch.slice(a, b - a)
                ids, ends = c.encode(part.column(1))
                back = c.decode(ids, ends)
                written = [",".join(decimal[ids[x:y]]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in written], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, SCHEMA)


def encode_documents(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            for a, b in slices(as_array(batch.column(1)), 4 << 20):
                part = batch.slice(a, b - a)
                ids, ends = c.encode(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))],
                    ["doc_id", "ids"])

    plain = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            ends = lists.offsets.to_numpy()
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(c.decode(ids, (ends - ends[0]).astype(np.int64)), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
