"""Level-wise doubling: removal of word windows that also start in an earlier document.

A window is ``width`` (13) words. Candidates are all windows, and they must survive
stretches of 6, then 12 words (twice that length), then the whole window:

* level 6 and 12: a window stands for the smallest of its stretches of that length. Equal
  windows agree on it, so a window whose smallest stretch lies in one document only has
  no twin and is dropped. About two stretches in nine are ever shuffled at the first level,
  and only those of surviving windows at the next one.
* level 13: surviving windows are compared as wholes by a 96-bit hash. A window is removed
  if its smallest document id is smaller than the document's own.

Documents of equal word sequences are one document from the second level on, and inside a batch
from the first one; the copies lose every word that lies in a window, which is what the rule says for them.
Tables that no later step reads are dropped on the way.

Defined results: null or empty text has no words, and the hash of no bytes. Documents
below ``width`` words are kept whole. A null id is neither smaller nor larger than any
other: such rows keep their words and remove nobody's. Rows of the same id do not
affect each other; repeated rows give a row each. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.spans import (
    Batch, by_document, changes, covered, groups_of_equals, in_other_documents, lists_of, members, sha256, smallest_inside,
)
from metricloom.llm.storage import drop_tables, stage, tables_made
from metricloom.llm.words import as_array, slices, sums_of, window_hashes

WIDTH = 13
LEVELS = (6, 12)
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of no bytes


def parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for batch in batches:
        for a, b in slices(as_array(batch.column(text))):
            part = batch.slice(a, b - a)
            yield part, Batch.of(part.column(text))


def first_of_equals(ids: pa.Array, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Which documents have the smallest id of those of the batch with the same word sequence."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((numbers, ~known, k2, k1))
    first = np.zeros(len(order), bool)
    first[order] = np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])[:len(order)]
    return first


def described(docs: DataFrame, level: int, width: int) -> DataFrame:
    """``doc_id``, the two keys of the word sequence, ``n_words``, the hash of all words, and first-level stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches, 1):
            _, rows, low = smallest_inside(words, level, width)
            k1, k2 = words.keys()
            new = changes(low, rows) & first_of_equals(part.column(0), k1, k2)[rows]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(k1), pa.array(k2), pa.array(words.counts, pa.int64()), sha256(words.joined()),
                lists_of(low[new].view(np.int64), rows[new], part.num_rows),
            ], ["doc_id", "k1", "k2", "n_words", "all_sha256", "stretches"])

    return docs.mapInArrow(
        run, "doc_id long, k1 long, k2 long, n_words long, all_sha256 string, stretches array<long>")


def next_level(active: DataFrame, before: int, level: int, width: int) -> DataFrame:
    """``doc_id`` and the stretches of ``level`` words of windows whose ``before``-word stretch is in ``alive``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches, 1):
            _, rows, low = smallest_inside(words, before, width)
            on = members(low.view(np.int64), rows, part.column(2))
            _, _, longer = smallest_inside(words, level, width)
            rows, longer = rows[on], longer[on]
            new = changes(longer, rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists_of(longer[new].view(np.int64), rows[new], part.num_rows)], ["doc_id", "stretches"])

    return active.select("doc_id", "text", "alive").mapInArrow(run, "doc_id long, stretches array<long>")


def whole_windows(active: DataFrame, before: int, width: int) -> DataFrame:
    """``doc_id`` and both hashes of every window whose ``before``-word stretch is in ``alive``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches, 1):
            starts, rows, low = smallest_inside(words, before, width)
            on = members(low.view(np.int64), rows, part.column(2))
            starts, rows = starts[on], rows[on]
            first = window_hashes(words.hashes, width, seed=1)[starts].view(np.int64)
            second = (window_hashes(words.hashes, width, seed=2)[starts] >> np.uint64(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), lists_of(first, rows, part.num_rows), lists_of(second, rows, part.num_rows, pa.int32()),
            ], ["doc_id", "h1", "h2"])

    return active.select("doc_id", "text", "alive").mapInArrow(run, "doc_id long, h1 array<long>, h2 array<int>")


def cut(active: DataFrame, width: int, *, texts: bool = False) -> DataFrame:
    """Remove the words of windows whose hash is in ``gone``; ``texts`` adds the kept words."""
    names = ["doc_id", "k1", "k2", "n_removed", "kept_sha256"] + ["kept_text"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches, 1):
            starts, rows, _ = smallest_inside(words, width, width)
            hashes = window_hashes(words.hashes, width, seed=1)[starts].view(np.int64)
            out = covered(starts[members(hashes, rows, part.column(2))], width, len(words.hashes))
            kept = words.joined(~out)
            k1, k2 = words.keys()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(k1), pa.array(k2), pa.array(sums_of(out, words.offsets)), sha256(kept)]
                + [kept] * texts, names)

    schema = "doc_id long, k1 long, k2 long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return active.select("doc_id", "text", "gone").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row."""
    plain = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")
    spark = docs.sparkSession
    with tables_made() as made:
        base = stage(described(plain, levels[0], width), "substrings-base")
        firsts = groups_of_equals(base)
        reps = firsts.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
        stretches = base.filter("doc_id is not null").select("doc_id", F.explode("stretches").alias("h"))
        alive = by_document(in_other_documents(stretches, ["h"]), "h", "alive").join(reps, "doc_id")
        active = stage(plain.join(alive, "doc_id"), "substrings-active")
        made[:] = drop_tables(spark, made, base, firsts, active)
        texts = active.drop("alive")
        for before, level in zip(levels, levels[1:], strict=False):
            longer = stage(next_level(active, before, level, width), f"substrings-{level}")
            found = in_other_documents(longer.select("doc_id", F.explode("stretches").alias("h")), ["h"])
            active = texts.join(by_document(found, "h", "alive"), "doc_id")
        windows = stage(whole_windows(active, levels[-1], width), f"substrings-{width}")
        made[:] = drop_tables(spark, made, base, firsts, texts, windows)
        rows = windows.select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")
        gone = by_document(in_other_documents(rows, ["h1", "h2"], F.col("doc_id") > F.col("first")), "h1", "gone")
    removed = cut(texts.join(gone, "doc_id"), width).dropDuplicates(["doc_id", "k1", "k2"])
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= width)
    return (
        base.drop("stretches").join(firsts.filter("held > 1"), ["k1", "k2"], "left").join(removed, ["doc_id", "k1", "k2"], "left")
        .select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        )
    )


def brute_force(rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """The definition, word by word; for tests."""
    import hashlib
    import re

    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[i:i + width])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out

