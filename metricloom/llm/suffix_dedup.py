"""Sparse suffix arrays: repeated passages of ``min_words`` words or more across documents.

1. Of each ``min_words``-word window the smallest ``anchor``-word stretch is content-selected
   (a minimiser): equal windows select equal stretches. Suffixes that begin at such
   positions are retained, about one in twenty-two, each as the hashes of its first
   ``KEY_WORDS`` words.
2. The suffixes are sorted across the cluster by ranges of (words, document), and
   neighbours are compared. A run of suffixes that share ``anchor`` words or more and lie
   in different documents survives. Runs at the border of a batch or range survive
   unchecked, so no run is ever gathered in one place.
3. Matches are extended left and right. First as far as the suffix's windows reach: the
   whole extent of an anchor is looked up by its hash, and copies of an extent are settled
   by one row each. Then window by window where extents differ: the first holder of each
   extent and all extents without a twin give their windows of ``min_words`` words.

The result is exact: a word is found if it lies in a window of ``min_words`` words that also
lies in a document with a smaller id. Documents of equal words are settled as wholes.

Defined results: null or empty texts and those below ``min_words`` words have no spans. Rows
with a null id neither have spans nor give any. Rows of the same id do not affect each
other; repeated rows have the same spans each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.spans import (
    Batch, by_document, changes, covered, groups_of_equals, in_other_documents, lists_of, members, smallest_inside,
)
from metricloom.llm.storage import partitions_for, stage
from metricloom.llm.words import as_array, mix, slices, spread, window_hashes

MIN_WORDS = 50
ANCHOR = 8
KEY_WORDS = 10
#: Suffixes in a range of the sort.
RANGE_SUFFIXES = 200_000
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
SPANS = "doc_id long, t long, start long, length long"


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for batch in batches:
        for a, b in slices(as_array(batch.column(1))):
            part = batch.slice(a, b - a)
            yield part, Batch.of(part.column(1))


def described(plain: DataFrame) -> DataFrame:
    """``doc_id, t``, the keys of the word sequence and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches):
            k1, k2 = words.keys()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(k1), pa.array(k2), pa.array(words.counts, pa.int64())],
                ["doc_id", "t", "k1", "k2", "n_words"])

    return plain.mapInArrow(run, "doc_id long, t long, k1 long, k2 long, n_words long")


def suffixes(plain: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """``words`` (big-endian 32-bit hashes of the suffix's first words), ``h`` (of the anchor) and ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches):
            _, rows, low = smallest_inside(words, anchor, min_words)
            new = changes(low, rows)
            rows, low = rows[new], low[new]
            if not len(rows):
                continue
            # Where the selected stretches begin: their hashes looked up in the document's own.
            at = _places(words, rows, low, anchor)
            n, last = len(words.hashes), words.offsets[1:][rows]
            key = np.zeros((len(at), KEY_WORDS), ">u4")
            for i in range(KEY_WORDS):
                inside = at + i < last
                key[inside, i] = (words.hashes[np.minimum(at + i, n - 1)][inside] >> np.uint64(32)).astype(np.uint32) | 1
            ids = part.column(0).take(pa.array(rows))
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * KEY_WORDS), len(at), [None, pa.py_buffer(key.tobytes())])
            yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), pa.array(low.view(np.int64)), ids], ["words", "h", "doc_id"])

    return plain.filter("doc_id is not null").mapInArrow(run, "words binary, h long, doc_id long")


def _places(words: Batch, rows: np.ndarray, low: np.ndarray, anchor: int) -> np.ndarray:
    """First place of each stretch ``low`` in its document."""
    inner = window_hashes(words.hashes, anchor, seed=anchor)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)[:len(inner)]
    keyed = mix(inner + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    wanted = mix(low + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    hit = np.flatnonzero(np.isin(keyed, wanted))
    order = hit[np.argsort(keyed[hit], kind="stable")]
    return order[np.searchsorted(keyed[order], wanted, side="left")]


def compared(table: DataFrame, anchor: int) -> DataFrame:
    """Sort the suffixes and keep those whose run of neighbours with ``anchor`` common words spans documents."""
    n = partitions_for(table.sparkSession, table.count(), RANGE_SUFFIXES)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").reshape(-1, KEY_WORDS)
            ids = batch.column(2).to_numpy()
            common = np.cumprod(words[1:] == words[:-1], axis=1).sum(axis=1)
            begin = np.concatenate([[True], common < anchor])
            starts = np.flatnonzero(begin)
            run = np.cumsum(begin) - 1
            several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            several[0] = several[-1] = True
            on = pa.array(several[run])
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(on), batch.column(1).filter(on)], ["doc_id", "h"])

    ordered = table.repartitionByRange(n, "words", "doc_id").sortWithinPartitions("words", "doc_id")
    return ordered.mapInArrow(neighbours, "doc_id long, h long")


def prefix_sums(hashes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and inverse powers, modulo 2**64, for hashes of ranges of any length."""
    n = len(hashes)
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)]), back


_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    sums, back = prefix_sums(mix(hashes + np.uint64(which)), _BASES[which])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def extents(words: Batch, alive: pa.Array, min_words: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Surviving windows (start, row, extent number) and for each extent its row, both hashes, start and end."""
    starts, rows, low = smallest_inside(words, anchor, min_words)
    on = members(low.view(np.int64), rows, alive)
    starts, rows, low = starts[on], rows[on], low[on]
    new = changes(low, rows)
    if len(starts):
        new |= np.concatenate([[True], np.diff(starts) != 1])
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    begin = starts[first]
    end = starts[np.concatenate([first[1:], [len(starts)]]) - 1] + min_words if len(first) else begin
    e1 = range_hashes(words.hashes, begin, end, 0).view(np.int64)
    e2 = (range_hashes(words.hashes, begin, end, 1) >> np.uint64(33)).astype(np.int32)
    return starts, rows, of, rows[first], e1, e2, begin, end


def extent_rows(active: DataFrame, min_words: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches):
            _, _, _, rows, e1, e2, _, _ = extents(words, part.column(2), min_words, anchor)
            yield pa.RecordBatch.from_arrays([
                part.column(0), lists_of(e1, rows, part.num_rows), lists_of(e2, rows, part.num_rows, pa.int32()),
            ], ["doc_id", "h1", "h2"])

    return active.select("doc_id", "text", "alive").mapInArrow(run, "doc_id long, h1 array<long>, h2 array<int>")


def window_rows(active: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """Windows of surviving anchors outside the extents that are copies of an earlier document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches):
            starts, rows, of, owner, e1, _, _, _ = extents(words, part.column(2), min_words, anchor)
            on = ~members(e1, owner, part.column(3))[of] if len(of) else np.zeros(0, bool)
            starts, rows = starts[on], rows[on]
            first = window_hashes(words.hashes, min_words, seed=1)[starts].view(np.int64)
            second = (window_hashes(words.hashes, min_words, seed=2)[starts] >> np.uint64(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), lists_of(first, rows, part.num_rows), lists_of(second, rows, part.num_rows, pa.int32()),
            ], ["doc_id", "h1", "h2"])

    return active.select("doc_id", "text", "alive", "copied").mapInArrow(run, "doc_id long, h1 array<long>, h2 array<int>")


def exploded(table: DataFrame) -> DataFrame:
    return table.select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")


def found_spans(active: DataFrame, min_words: int, anchor: int, texts: bool) -> DataFrame:
    """``doc_id, t, spans`` (and the text without them) of documents with repeated passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in parts(batches):
            starts, rows, _, owner, e1, _, begin, end = extents(words, part.column(2), min_words, anchor)
            copied = members(e1, owner, part.column(3))
            lengths = (end - begin)[copied]
            out = np.zeros(len(words.hashes), bool)
            out[spread(begin[copied], lengths)] = True
            hashes = window_hashes(words.hashes, min_words, seed=1)[starts].view(np.int64)
            out |= covered(starts[members(hashes, rows, part.column(4))], min_words, len(out))
            spans, kept = [], []
            for i, (a, b) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out[a:b].astype(np.int8), [0]])))
                own = list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))
                spans.append([{"start": s, "length": n} for s, n in own])
                if texts:
                    kept.append(without(part.column(1)[i].as_py(), own))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            columns = [part.column(0), part.column(5), pa.array(spans, kind)] + [pa.array(kept, pa.string())] * texts
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "spans"] + ["kept"] * texts)

    schema = "doc_id long, t long, spans array<struct<start:long,length:long>>" + ", kept string" * texts
    return active.select("doc_id", "text", "alive", "copied", "gone", "t").mapInArrow(run, schema)


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans; white space outside them stays."""
    if text is None or not spans:
        return text
    data = text.encode()
    words = [m.span() for m in SPACE.finditer(data)]
    out, last = [], 0
    for start, length in spans:
        out.append(data[last:words[start][0]])
        last = words[start + length - 1][1]
    return b"".join([*out, data[last:]]).decode()


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
             anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """``doc_id, t`` (hash of the text), ``n_words``, ``spans`` and ``first_doc_id`` of documents with repeated passages."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    plain = plain.withColumn("t", F.xxhash64("text"))
    base = stage(described(plain), "suffix-base")
    firsts = groups_of_equals(base)
    reps = firsts.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    table = stage(suffixes(plain.select("doc_id", "text"), min_words, anchor), "suffix-table")
    alive = by_document(compared(table, anchor), "h", "alive").join(reps, "doc_id")
    active = stage(plain.join(alive, "doc_id"), "suffix-active")
    whole = stage(extent_rows(active, min_words, anchor), "suffix-extents")
    later = F.col("doc_id") > F.col("first")
    copied = in_other_documents(exploded(whole), ["h1", "h2"], later)
    copied = copied.groupBy("doc_id").agg(F.collect_list("h1").alias("copied"), F.min("first").alias("first_a"))
    active = stage(active.join(copied, "doc_id", "left"), "suffix-extended")
    windows = stage(window_rows(active, min_words, anchor), "suffix-windows")
    gone = in_other_documents(exploded(windows), ["h1", "h2"], later)
    gone = gone.groupBy("doc_id").agg(F.collect_list("h1").alias("gone"), F.min("first").alias("first_b"))
    last = active.join(gone, "doc_id", "left").filter("copied is not null or gone is not null")
    firsts_of = last.select("doc_id", F.least("first_a", "first_b").alias("first_doc_id")).distinct()
    own = found_spans(last, min_words, anchor, texts).dropDuplicates(["doc_id", "t"]).join(firsts_of, "doc_id")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= min_words)
    copies = base.join(firsts.filter("held > 1"), ["k1", "k2"]).filter(copy).dropDuplicates(["doc_id", "t"]).select(
        "doc_id", "t", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"))).alias("spans"),
        *[F.lit("").alias("kept")] * texts, F.col("rep").alias("first_doc_id"))
    # A document that is a copy of another has that result only.
    found = copies.unionByName(own.join(copies.select("doc_id", "t"), ["doc_id", "t"], "left_anti"))
    return found.filter(F.size("spans") > 0)


def repeated_spans(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, start, length, first_doc_id``: word ranges that repeat an earlier document, one row each."""
    found = repeated(docs, **options)
    return found.select("doc_id", F.explode("spans").alias("s"), "first_doc_id").select(
        "doc_id", "s.start", "s.length", "first_doc_id")


def remove_repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; documents that lose their last word go."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    d, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    found = repeated(inner, doc_id=d, text=t, texts=True, **options).select("doc_id", "t", "kept")
    joined = inner.join(found, (F.col(d) == F.col("doc_id")) & (F.xxhash64(t) == F.col("t")), "left")
    joined = joined.filter(F.col("kept").isNull() | F.col("kept").rlike(r"[^ \t-\r]"))
    return joined.select(*[
        (F.coalesce(F.col("kept"), F.col(c)) if c == t else F.col(c)).alias(n) for c, n in
        zip([f"c{i}" for i in range(len(names))], names, strict=True)
    ])


def brute_force(rows: list[tuple[int | None, str | None]], min_words: int = MIN_WORDS) -> set[tuple[int, int, int]]:
    """(doc_id, start, length) by the definition; for tests."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - min_words + 1):
            if d is not None:
                key = tuple(w[i:i + min_words])
                first[key] = min(first.get(key, d), d)
    out = set()
    for d, w in words:
        gone = np.zeros(len(w) + 2, np.int8)
        for i in range(len(w) - min_words + 1):
            if d is not None and first[tuple(w[i:i + min_words])] < d:
                gone[i + 1:i + 1 + min_words] = 1
        edge = np.flatnonzero(np.diff(gone))
        out.update((d, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True))
    return out
