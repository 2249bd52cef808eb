"""Shared steps of the operators that remove word windows which start in an earlier document."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.storage import stage
from metricloom.llm.words import mix, split_words, window_hashes, window_starts, word_hashes


@dataclass
class Batch:
    """The words of some texts: 64-bit hashes in one flat array, and the words themselves."""

    hashes: np.ndarray
    offsets: np.ndarray
    numbers: np.ndarray
    distinct: pa.Array

    @classmethod
    def of(cls, texts: pa.Array) -> Batch:
        numbers, distinct, offsets = split_words(texts)
        hashes = word_hashes(distinct)
        return cls(hashes[numbers] if len(hashes) else np.zeros(0, np.uint64), offsets, numbers, distinct)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def joined(self, keep: np.ndarray | None = None) -> pa.Array:
        """Each text's (kept) words joined by one space."""
        numbers, offsets = self.numbers, self.offsets
        if keep is not None:
            numbers, offsets = numbers[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        words = self.distinct.take(pa.array(numbers)) if len(numbers) else pa.array([], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each text's word sequence."""
        place = np.arange(len(self.hashes), dtype=np.int64) - np.repeat(self.offsets[:-1], self.counts)
        found = []
        for seed in (1, 2):
            each = mix(mix(self.hashes + np.uint64(seed)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
            found.append(mix(total[self.offsets[1:]] - total[self.offsets[:-1]] + self.counts.astype(np.uint64)).view(np.int64))
        return found[0], found[1]


def smallest_inside(batch: Batch, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its start, its document's row, and the smallest hash of its ``length``-word stretches.

    Equal windows have equal smallest stretches, wherever they lie.
    """
    starts, rows = window_starts(batch.offsets, window)
    if not len(starts):
        return starts, rows, np.zeros(0, np.uint64)
    inner = window_hashes(batch.hashes, length, seed=length)
    n = len(inner) - (window - length)
    low = inner[:n].copy()
    for shift in range(1, window - length + 1):
        np.minimum(low, inner[shift:shift + n], out=low)
    return starts, rows, low[starts]


def changes(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before or belongs to another document."""
    if not len(values):
        return np.zeros(0, bool)
    return np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])


def lists_of(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType | None = None) -> pa.Array:
    """The values of each of ``n`` rows as lists; ``rows`` ascends."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind or pa.int64()))


def members(values: np.ndarray, rows: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in its row's list."""
    inside = np.zeros(len(values), bool)
    if not len(values):
        return inside
    ends = np.searchsorted(rows, np.arange(len(lists) + 1))
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b > a and lists[i].is_valid:
            inside[a:b] = np.isin(values[a:b], lists[i].values.to_numpy(zero_copy_only=False))
    return inside


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in one of the windows."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def in_other_documents(rows: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """Rows ``keys, doc_id`` whose key lies in documents of different ids, with the smallest id as ``first``.

    The smallest and largest ids come from a partial aggregation. They are written to a
    table, so that the join back to the rows lies between two plain exchanges and a key
    that many documents hold is split at run time.
    """
    ends = rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    ends = stage(ends, "repeated-keys")
    found = rows.join(ends.drop("last"), keys)
    return found if keep is None else found.filter(keep)


def groups_of_equals(base: DataFrame) -> DataFrame:
    """``k1, k2, rep`` (the smallest id) and ``held`` of each word sequence, written.

    So rows that join it lie between two plain exchanges, and a sequence that many documents have is split at run time.
    """
    return stage(base.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")), "equal-texts")


def by_document(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(value).alias(name))
