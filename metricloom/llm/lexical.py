"""Ranked lexical search by Block-Max MaxScore over index shards, with heaps merged at the end.

The index is a written table. A shard holds the documents of one slice of a task's texts (about
``SLICE_BYTES``); a row is one term of a shard:

* ``data``: its postings in blocks of ``BLOCK`` documents, each block by itself as variable-length
  integers (gap to the document before, impact). An impact is the term's exact score in the document
  before the weight, from the counts over all documents, so block maxima are exact bounds;
* ``firsts``, ``maxima``, ``ends``: the first document, the largest impact and the last byte of each block.

A row without a term holds the shard's document ids. Search sends to each group of shards the rows of
terms that some item asks for, and the items, in blocks of ``ITEMS``. A group goes through its shards and
keeps one heap for each item, whose last score is the bar for the next shard:

1. Lists are read and added up, largest bound first, and the k-th sum raises the bar, until the bounds of
   all lists left stay below it together. Those are non-essential: a document with no other term cannot pass.
2. Non-essential lists follow, largest bound first. A candidate whose sum, block maximum and the bounds of
   the lists after it stay below the bar goes before the block is decoded; only blocks that still
   have candidates are decoded.

Each group emits k rows for each item. Weights need the document counts of the asked terms only.

Defined results: null and empty texts have no terms and are not counted as documents. Rows of one doc_id are
documents of their own; rows without an id count and are listed after others of the same score, with a null
id. Rows of one item_id are one item with the terms of each; null, empty or unknown texts give an item no
rows. Empty tables give no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.storage import partitions_for, stage
from metricloom.llm.words import as_array, slices, split_words

NEAREST, BLOCK, ITEMS = 10, 128, 4096
#: Postings of a group of shards, all terms counted.
GROUP_POSTINGS = 8 << 20
INDEX = ("shard long, term string, n long, firsts array<int>, maxima array<int>, ends array<int>, data binary, "
         "doc_ids array<long>")
FOUND = "item_id long, doc_id long, score long"

#: ASCII letters in lower case and digits, other ASCII as spaces, bytes of other characters as they are.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with terms in lower case and every separator a space; null texts are empty."""
    texts = as_array(pc.fill_null(texts, ""))
    large = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    offsets = np.frombuffer(ends, np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    moved = bytes(memoryview(data)[offsets[0]:offsets[-1]]).translate(LETTERS)
    return pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(moved)])


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as variable-length bytes, low groups of seven bits first, and the length of each."""
    lengths = np.ones(len(values), np.int64)
    for k in range(1, 5):
        lengths += values >= 1 << 7 * k
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(int(lengths.max(initial=0))):
        at = np.flatnonzero(lengths > k)
        out[starts[at] + k] = (values[at] >> 7 * k & 127) | np.where(lengths[at] > k + 1, 128, 0)
    return out, lengths


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def length_factor(n, documents: int, terms: int):
    """The factor ``m`` of documents of ``n`` terms."""
    return 10 + 90 * n * documents // max(terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def shard_rows(texts: pa.Array, doc_ids: pa.Array, shard: int, documents: int, terms: int) -> pa.RecordBatch:
    """The index rows of the shard that these documents make."""
    numbers, distinct, offsets = split_words(spaced(texts))
    n = np.diff(offsets)
    keys, tf = np.unique(numbers.astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    term, doc = keys // max(len(n), 1), keys % max(len(n), 1)
    impact = impacts(tf, length_factor(n, documents, terms)[doc]) if len(doc) else np.zeros(0, np.int64)
    size = np.bincount(term, minlength=len(distinct))
    lists = np.cumsum(size) - size
    blocks_of = -(-size // BLOCK)
    place = np.arange(len(term)) - lists[term]
    starts = np.flatnonzero(place % BLOCK == 0)
    gap = np.diff(doc, prepend=0)
    gap[starts] = 0
    data, lengths = packed_numbers(np.stack([gap, impact], 1).ravel())
    # Bytes up to the end of each block, over the shard and from the term's first byte on.
    ends = np.concatenate([[0], np.cumsum(lengths)])[2 * np.append(starts[1:], len(term))] if len(term) else np.zeros(0, np.int64)
    # Blocks and bytes before each term; an empty word, which has no postings, may be the first.
    blocks_before = np.concatenate([[0], np.cumsum(blocks_of)])
    bytes_of = np.concatenate([[0], ends])[blocks_before]
    block_term = np.repeat(np.arange(len(distinct)), blocks_of)
    edges = pa.array(blocks_before, pa.int32())

    def of_blocks(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(edges, pa.array(values, pa.int32()))

    rows = [
        pa.array(np.full(len(distinct), shard), pa.int64()), distinct.cast(pa.string()), pa.array(size, pa.int64()), of_blocks(doc[starts]),
        of_blocks(np.maximum.reduceat(impact, starts) if len(starts) else starts), of_blocks(ends - bytes_of[block_term]),
        pa.Array.from_buffers(pa.binary(), len(distinct), [None, pa.py_buffer(bytes_of.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
        pa.nulls(len(distinct), pa.list_(pa.int64())),
    ]
    names = ["shard", "term", "n", "firsts", "maxima", "ends", "data", "doc_ids"]
    ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), as_array(doc_ids))
    own = [pa.array([shard], pa.int64()), pa.nulls(1, pa.string()), pa.array([len(doc)], pa.int64()),
           *[pa.nulls(1, pa.list_(pa.int32()))] * 3, pa.nulls(1, pa.binary()), ids]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(rows, own, strict=True)], names)


def corpus_counts(texts: DataFrame) -> tuple[int, int]:
    """The documents that have a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for a, b in slices(as_array(batch.column(0))):
                n = np.diff(split_words(spaced(batch.column(0).slice(a, b - a)))[2])
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])

    found = texts.mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The written index of all rows, and the number of documents that have a term."""
    plain = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")
    documents, terms = corpus_counts(plain.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slices(as_array(batch.column(1))):
                yield shard_rows(batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a), shard, documents, terms)
                shard += 1

    return stage(plain.mapInArrow(run, INDEX), "lexical-index"), documents


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, term``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, distinct, offsets = split_words(spaced(batch.column(1)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), distinct.cast(pa.string()).take(pa.array(numbers))], ["item_id", "term"])

    plain = items.selectExpr(f"cast(`{item_id}` as long) item_id", f"cast(`{text}` as string) text")
    return plain.mapInArrow(run, "item_id long, term string").distinct()


def weight(documents: int, df: str):
    return F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2.0 * F.col(df) + 1))).cast("long")


class Shard:
    """The asked lists of one shard; whole lists are decoded once for all items."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        terms = rows["term"].to_pylist()
        self.row = {t: i for i, t in enumerate(terms) if t is not None}
        own = rows["doc_ids"].take(pa.array([terms.index(None)])).combine_chunks().values
        self.no_id = own.is_null().to_numpy(zero_copy_only=False)
        # Rows without an id come last among equal scores.
        self.doc_ids = pc.fill_null(own, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        columns = {c: as_array(rows[c]) for c in ("firsts", "maxima", "ends", "data")}
        self.firsts, self.maxima, self.ends = (
            [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in columns[c]] for c in ("firsts", "maxima", "ends"))
        self.data = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in columns["data"]]
        self.n, self.whole = rows["n"].to_numpy(), {}
        #: Decoded and skipped blocks, for tests.
        self.decoded = self.skipped = 0

    def blocks(self, i: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the chosen blocks of list ``i``."""
        self.decoded += len(chosen)
        ends = self.ends[i]
        if len(chosen) == len(ends):
            values = unpacked_numbers(self.data[i])
        else:
            values = unpacked_numbers(np.concatenate([self.data[i][ends[b - 1] if b else 0:ends[b]] for b in chosen.tolist()]))
        sizes = np.minimum(self.n[i] - chosen * BLOCK, BLOCK)
        run = np.cumsum(values[::2])
        before = np.cumsum(sizes) - sizes
        return run + np.repeat(self.firsts[i][chosen] - run[before], sizes), values[1::2]

    def all(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.whole:
            self.whole[i] = self.blocks(i, np.arange(len(self.ends[i])))
        return self.whole[i]

    def best(self, terms: list[str], weights: list[int], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of at least ``bar`` that can be among the ``k`` best, with their scores."""
        here = sorted((int(w) * int(self.maxima[i].max()), int(w), i)
                      for t, w in zip(terms, weights, strict=True) if w > 0 and (i := self.row.get(t)) is not None)
        sums = np.cumsum([0, *(b for b, _, _ in here)])
        if sums[-1] < max(bar, 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total, bar, essential = np.zeros(len(self.doc_ids), np.int64), max(bar, 1), len(here)
        # Essential lists: without them the smaller ones together may still reach the bar.
        while essential and sums[essential] >= bar:
            essential -= 1
            _, w, i = here[essential]
            docs, impact = self.all(i)
            total[docs] += w * impact
            bar = max(bar, _kth(total[docs], k))
        at = np.flatnonzero(total)
        score = total[at]
        for j in range(essential - 1, -1, -1):
            _, w, i = here[j]
            # What the lists from here on can add at most.
            on = score + sums[j + 1] >= bar
            at, score = at[on], score[on]
            if not len(at):
                break
            block = np.searchsorted(self.firsts[i], at, "right") - 1
            possible = np.where(block >= 0, w * self.maxima[i][block].astype(np.int64), 0)
            on = score + possible + sums[j] >= bar
            at, score, block = at[on], score[on], block[on]
            wanted = np.unique(block[block >= 0])
            self.skipped += len(self.ends[i]) - len(wanted)
            if len(wanted):
                docs, impact = self.whole[i] if i in self.whole else self.blocks(i, wanted)
                place = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
                score = score + np.where(docs[place] == at, w * impact[place], 0)
                bar = max(bar, _kth(score, k))
        on = score >= bar
        return at[on], score[on]


def _kth(score: np.ndarray, k: int) -> int:
    return int(np.partition(score, -k)[-k]) if len(score) >= k else 0


def top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def search(index: DataFrame, documents: int, items: DataFrame, *, item_id: str = "item_id", text: str = "text",
           k: int = NEAREST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    terms = stage(item_terms(items, item_id, text), "lexical-item-terms")
    held = index.filter("term is not null").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weights = stage(held.select("term", weight(documents, "df").alias("w")), "lexical-weights")
    asked = terms.join(weights, "term").groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    blocks = max(1, -(-terms.select("item_id").distinct().count() // ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    postings = index.filter("term is null").agg(F.sum("n")).first()[0] or 0
    groups = partitions_for(index.sparkSession, postings, GROUP_POSTINGS)
    group = F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("group")
    # The blocks of items that ask for a term; every block needs the document ids of a shard.
    wanted = stage(terms.join(weights.filter("w > 0"), "term").select(
        "term", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).distinct(), "lexical-wanted")
    lists = index.filter("term is not null").join(wanted, "term")
    ids = index.filter("term is null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    columns = ["block", group, "shard", "term", "n", "firsts", "maxima", "ends", "data", "doc_ids"]
    left = lists.select(columns).union(ids.select(columns))
    right = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def serve(rows: pa.Table, asked: pa.Table) -> pa.Table:
        queries = list(zip(*(asked[c].to_pylist() for c in ("item_id", "terms", "weights")), strict=True))
        nothing = np.zeros(0, np.int64)
        heaps = [(nothing, nothing, np.zeros(0, bool))] * len(queries)
        number = rows["shard"].to_numpy()
        for s in np.unique(number).tolist() if queries else []:
            shard = Shard(rows.take(pa.array(np.flatnonzero(number == s))))
            for q, (_, terms, weights) in enumerate(queries):
                ids, score, no_id = heaps[q]
                at, found = shard.best(terms, weights, k, int(score[-1]) if len(score) == k else 0)
                if len(at):
                    ids, score = np.concatenate([ids, shard.doc_ids[at]]), np.concatenate([score, found])
                    no_id = np.concatenate([no_id, shard.no_id[at]])
                    first = top(ids, score, k)
                    heaps[q] = ids[first], score[first], no_id[first]
        sizes = [len(ids) for ids, _, _ in heaps]
        names = pa.array([q[0] for q in queries], pa.int64()).take(pa.array(np.repeat(np.arange(len(queries)), sizes)))
        ids, score, no_id = (np.concatenate([z, *(h[c] for h in heaps)]) for c, z in enumerate((nothing, nothing, np.zeros(0, bool))))
        return pa.table([names, pa.array(ids, pa.int64(), mask=no_id), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    found = left.repartition(groups, "group", "block").groupBy("group", "block").cogroup(
        right.repartition(groups, "group", "block").groupBy("group", "block")).applyInArrow(serve, FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, *, k: int = NEAREST) -> DataFrame:
    """Index ``docs`` and search it for all ``items``."""
    index, documents = build_index(docs)
    return search(index, documents, items, k=k)


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], k: int = NEAREST) -> list[tuple]:
    """(item_id, rank, doc_id, score) by the definition; for tests."""
    import math
    import re
    from collections import Counter

    def terms(text: str | None) -> list[str]:
        found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        return ["".join(c.lower() if c.isascii() else c for c in t) for t in found]

    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    df = Counter(t for _, c in held for t in c)
    total = sum(sum(c.values()) for _, c in held)
    asked: dict[int | None, set[str]] = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in wanted if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out
