"""Byte-level BPE over batches of words in numpy: merge rounds, and decoding.

All symbols of all words lie in one flat array. A round finds each word's pair of
lowest rank by binary search over the sorted pair keys, merges all its occurrences
in the word, and closes the gaps; words without a known pair leave the array. A
merge's result can only take part in merges of higher rank, so a round per word and
rank gives the same ids as merging one pair at a time. Words of over ``LONG`` bytes
would need many rounds for few words; a heap of pairs handles them one by one.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

from metricloom.llm.encoding import byte_alphabet
from metricloom.llm.words import spread

LONG = 192
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        model = description["model"]
        ids: dict[str, int] = model["vocab"]
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or model.get("ignore_merges") or unsupported:
            raise ValueError(f"{path} is not plain byte-level BPE: {unsupported or model['type']}")
        added = {t["content"]: t["id"] for t in description.get("added_tokens", [])}
        self.special = {content: i for content, i in added.items() if content}
        alphabet = byte_alphabet()
        self.first = np.array([ids[c] for c in alphabet], np.int32)
        self.size = max([*ids.values(), *added.values()]) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        if len(np.unique(made)) != len(made):
            raise ValueError(f"{path}: two merges give one token, so merges of a round are not independent")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        of_char = {c: b for b, c in enumerate(alphabet)}
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(of_char[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_length = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted keys, -1 for pairs that never merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1).astype(np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words after one another, and the number of each word's ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray | None] = [None] * 0
        found_ids, found_words = out, []
        for i in np.flatnonzero(lengths > LONG):
            ids = self._encode_long(words[i])
            found_ids.append(ids)
            found_words.append(np.full(len(ids), i))
        short = np.flatnonzero((lengths <= LONG) & (lengths > 0))
        symbols = self.first[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        word = np.repeat(short, lengths[short])
        pair = self._pairs(symbols, word)
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(word)]]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), counts)
            done = lowest == _NONE
            if done.any():
                found_ids.append(symbols[done])
                found_words.append(word[done])
                on = ~done
                symbols, word, pair, rank, lowest = symbols[on], word[on], pair[on], rank[on], lowest[on]
                if not len(symbols):
                    break
            symbols, word, pair = self._merge(symbols, word, pair, rank == lowest)
        ids = np.concatenate(found_ids) if found_ids else np.zeros(0, np.int32)
        owner = np.concatenate(found_words) if found_words else np.zeros(0, np.int64)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair = np.full(len(symbols), -1, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair[inside] = self.look_up(symbols[inside], symbols[inside + 1])
        return pair

    def _merge(self, symbols, word, pair, chosen):
        """Merge the chosen pairs from the left; of overlapping ones (equal symbols) every second."""
        at = np.flatnonzero(chosen)
        run = np.cumsum(np.concatenate([[True], np.diff(at) != 1])) - 1
        begin = at[np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))]
        at = at[(at - begin[run]) % 2 == 0]
        symbols[at] = self.made[pair[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, word, pair, at = symbols[keep], word[keep], pair[keep], moved[at]
        stale = np.concatenate([at, at[at > 0] - 1])
        pair[stale] = -1
        last = len(symbols) - 1
        stale = stale[stale < last]
        stale = stale[word[stale] == word[stale + 1]]
        pair[stale] = self.look_up(symbols[stale], symbols[stale + 1])
        return symbols, word, pair

    def _encode_long(self, text: bytes) -> np.ndarray:
        symbols = self.first[np.frombuffer(text, np.uint8)].tolist()
        n = len(symbols)
        following, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.look_up(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(int(self.rank[p]), i, int(p)) for i, p in enumerate(first.tolist()) if p >= 0]
        heapq.heapify(heap)
        keys, size = self.keys, self.size

        def push(i: int) -> None:
            j = following[i]
            if j < n:
                key = symbols[i] * size + symbols[j]
                p = int(np.searchsorted(keys, key))
                if p < len(keys) and keys[p] == key:
                    heapq.heappush(heap, (int(self.rank[p]), i, p))

        while heap:
            _, i, p = heapq.heappop(heap)
            j = following[i]
            if not alive[i] or j >= n or symbols[i] * size + symbols[j] != keys[p]:
                continue
            symbols[i], alive[j] = int(self.made[p]), False
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([s for s, a in zip(symbols, alive, strict=True) if a], np.int32)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each range of ids, malformed UTF-8 replaced."""
        lengths = self.piece_length[ids]
        data = self.pieces[spread(self.piece_start[ids], lengths)].tobytes()
        at = np.concatenate([[0], np.cumsum(lengths)])[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
