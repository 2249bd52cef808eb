"""Whole texts to token ids with the ``tokenizers`` library, each distinct word encoded once.

For a tokenizer whose pre-tokenizer drops white space and never looks across it, a
text's ids are its words' ids one after the other, so a task encodes distinct words
only and copies the results. ``separable`` checks the tokenizer's own description
for that property; any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from metricloom.llm.words import spread, split_words, sums_of

# Fixed value: the pre-tokenizer pattern for which words are independent. Every alternative matches
# characters other than white space only, and none looks ahead or behind.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,;:!?"
#: Latin letters below U+0250 and marks after them: NFC keeps them, they have one lower-case letter each,
#: and whatever surrounds them they are one pre-token of letters and one of marks.
SIMPLE = rf"^[A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{12F}}\x{{131}}-\x{{24F}}]+[{MARKS}]*$"
#: Words that a worker keeps with their ids; words beyond that are encoded anew in each batch.
CACHE_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return [shown[b] for b in range(256)]


def separable(description: dict) -> bool:
    """Whether the ids of a text are those of its white-space-separated words in turn."""
    normalizer = description.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normalizer.get("normalizers", [normalizer])
    plain = all(
        s["type"] in ("NFC", "Lowercase")
        or (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ")
        for s in steps
    )
    lower = any(s["type"] == "Lowercase" for s in steps)
    pre = (description.get("pre_tokenizer") or {}).get("pretokenizers", [])
    splits = (
        len(pre) == 2
        and pre[0].get("pattern") == {"Regex": WORD_PATTERN} and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
        and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    )
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]))
        for t in description.get("added_tokens", [])
    )
    return bool(plain and lower and splits and added)


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Ids of Arrow arrays of texts; null texts are empty."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = separable(description)
        self.model = self.tokenizer.model
        # The byte characters of a word's UTF-8 form, as the byte-level pre-tokenizer would give them.
        self.table = {b: c for b, c in enumerate(byte_alphabet())}
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("Q", [0])

    def _slots(self, words: list[str], letters: bool) -> np.ndarray:
        """Where the ids of each word are kept; words not yet known are encoded."""
        known = self.known
        missing = [w for w in words if w not in known]
        if letters:
            tokenize, table, flat, ends = self.model.tokenize, self.table, self.flat, self.ends
            extend = flat.extend
            for w in missing:
                shown = w if w.isascii() else w.encode().decode("latin-1").translate(table)
                extend([t.id for t in tokenize(shown)])
                known[w] = len(ends) - 1
                ends.append(len(flat))
        else:
            for w, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self.flat.extend(e.ids)
                known[w] = len(self.ends) - 1
                self.ends.append(len(self.flat))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and start and length of the first and the second part of each distinct word."""
        # The newest words beyond the cache size are forgotten; the oldest are the frequent ones.
        while len(self.known) > CACHE_WORDS:
            self.known.popitem()
        del self.ends[len(self.known) + 1:]
        del self.flat[self.ends[-1]:]
        fast = pc.match_substring_regex(distinct, SIMPLE).to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1, np.int64)
        at = np.flatnonzero(fast)
        if len(at):
            lower = pc.utf8_lower(distinct.take(pa.array(at)))
            core = pc.utf8_rtrim(lower, MARKS)
            cores = core.dictionary_encode()
            first[at] = self._slots(strings(cores.dictionary), True)[cores.indices.to_numpy()]
            marked = np.flatnonzero(pc.not_equal(pc.binary_length(lower), pc.binary_length(core)).to_numpy(zero_copy_only=False))
            if len(marked):
                tails = pc.replace_substring_regex(lower.take(pa.array(marked)), f"^[^{MARKS}]+", "").dictionary_encode()
                second[at[marked]] = self._slots(strings(tails.dictionary), False)[tails.indices.to_numpy()]
        at = np.flatnonzero(~fast)
        if len(at):
            first[at] = self._slots(strings(distinct.take(pa.array(at))), False)
        ends = np.array(self.ends, np.int64)
        lengths = np.diff(ends)
        two = second >= 0
        return (np.array(self.flat, np.uint32), ends[first], lengths[first],
                np.where(two, ends[second], 0), np.where(two, lengths[second], 0))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_word:
            return np.fromiter((len(e.ids) for e in self._whole(texts)), np.int64, len(texts))
        numbers, distinct, offsets = split_words(texts)
        if not len(distinct):
            return np.zeros(len(texts), np.int64)
        _, _, n1, _, n2 = self._distinct(distinct)
        return sums_of((n1 + n2)[numbers], offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another (unsigned 32-bit), and where each text's ids start (one more at the end)."""
        if not self.by_word:
            lists = [e.ids for e in self._whole(texts)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            return np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1])), ends
        numbers, distinct, offsets = split_words(texts)
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        flat, s1, n1, s2, n2 = self._distinct(distinct)
        # Both parts of each distinct word together, then one copy for each occurrence.
        parts = np.stack([n1, n2], 1).ravel()
        joined = flat[spread(np.stack([s1, s2], 1).ravel(), parts)]
        lengths = n1 + n2
        starts = np.cumsum(lengths) - lengths
        each = lengths[numbers]
        ids = joined[spread(starts[numbers], each)]
        return ids, np.concatenate([[0], np.cumsum(sums_of(each, offsets))])

    def _whole(self, texts: pa.Array):
        return self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker, with the words it has seen."""
    return TextEncoder(path)
