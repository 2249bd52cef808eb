"""Approximate nearest neighbours by cross-polytope hashing with exact reranking.

Each of ``tables`` tables rotates a unit vector by three rounds of random signs and a fast
Hadamard transform, and assigns it to the nearest signed axis: one of twice the padded
dimension. A query also probes the next nearest axes, ``probes`` in all. What a bucket
holds is scored by inner products in double precision on the original vectors.

A bucket of more than ``block_rows`` vectors is dealt over several tasks by a hash of the id,
and its queries go to each of them; the counts of the buckets (a number fixed by
tables and dimension) decide how many. Each task returns its best per query, so a query
gathers ``k`` rows for each probed block. A query that found fewer than ``k`` is asked again
of every row, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows with a null id take no part; nor do vectors of another length than most have. Rows
of a query's own id are no candidates. Several rows of one id count with their best score,
and several queries of one id share one list. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.storage import partitions_for, stage

TABLES, PROBES, NEAREST, BLOCK_ROWS, SEED = 24, 4, 20, 1024, 7
#: Vectors, a copy for each table, in a group of cells.
CELL_ROWS = 20_000
FOUND = "query_id long, vec_id long, score double"


def fast_hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    width, half = rows.shape[1], 1
    out = rows
    while half < width:
        pairs = out.reshape(-1, width // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(-1, width)
        half *= 2
    return out / np.sqrt(width)


@functools.lru_cache(maxsize=4)
def signs(seed: int, tables: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))


def axes(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """For each vector and table the ``probes`` nearest signed axes, nearest first, numbered over all tables."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    padded = np.zeros((len(vectors), width))
    padded[:, :vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = np.zeros((len(vectors), tables, min(probes, 2 * width)), np.int64)
    for t, rounds in enumerate(signs(seed, tables, width)):
        turned = padded
        for r in rounds:
            turned = fast_hadamard(turned * r)
        both = np.concatenate([turned, -turned], 1)
        found[:, t] = 2 * width * t + np.argsort(-both, axis=1, kind="stable")[:, :found.shape[2]]
    return found


def usable(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """``vec_id, v`` (double components) of the rows that take part, and their dimension."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return (rows.filter(F.size("v") == common["size"]), common["size"]) if common else (rows, 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def hashed(rows: DataFrame, width: int, tables: int, probes: int, seed: int) -> DataFrame:
    """``vec_id, v, buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = axes(matrix(batch.column(1), width), tables, probes, seed).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.int64()))], ["vec_id", "v", "buckets"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, buckets array<long>")


def best_of_block(left: pa.Table, right: pa.Table, width: int, k: int) -> pa.Table:
    """The ``k`` best ids of a block for each of its queries, each with its best row."""
    out_q, out_v, out_s = [], [], []
    if left.num_rows and right.num_rows:
        asked, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(ids) != 0]))
        q, x = matrix(left["q"], width), matrix(right["v"], width)[by_id]
        for i in range(0, len(asked), 256):
            # Not a BLAS call: its threads would compete with the other tasks of the machine.
            rough = np.einsum("ij,kj->ik", q[i:i + 256], x)
            rough[asked[i:i + 256, None] == ids[None, :]] = -np.inf
            # A little below the k-th best id, so that the order of a sum decides nothing.
            of_id = np.maximum.reduceat(rough, firsts, axis=1) if len(firsts) < len(ids) else rough
            limit = np.partition(of_id, -k, axis=1)[:, -k] if len(firsts) > k else np.full(len(rough), -np.inf)
            slack = 1e-12 * np.maximum(np.abs(rough).max(axis=1, initial=0, where=np.isfinite(rough)), 1e-300)
            a, b = np.nonzero((rough >= (limit - slack)[:, None]) & np.isfinite(rough))
            score = (q[i + a] * x[b]).sum(axis=1)
            # Several rows of one id: the best one.
            order = np.lexsort((-score, ids[b], a))
            a, b, score = a[order], b[order], score[order]
            new = np.ones(len(a), bool)
            new[1:] = (np.diff(a) != 0) | (np.diff(ids[b]) != 0)
            a, b, score = a[new], b[new], score[new]
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            on = place < k
            out_q.append(asked[i + a[on]])
            out_v.append(ids[b[on]])
            out_s.append(score[on])
    ids = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (out_q, out_v)]
    return pa.table([pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()),
                     pa.array(np.concatenate([*out_s, np.zeros(0)]), pa.float64())], names=["query_id", "vec_id", "score"])


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best, ties to the smaller id, ranked from 1."""
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def in_blocks(asked: DataFrame, held: DataFrame, width: int, k: int, cells: int) -> DataFrame:
    """Match queries and vectors of the same (bucket, block); a group of one task holds several of those cells."""
    cell = F.pmod(F.xxhash64("bucket", "block"), F.lit(cells))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        x = _sorted(left)
        y = _sorted(right)
        for key in x.keys() & y.keys():
            parts.append(best_of_block(left.take(x[key]), right.take(y[key]), width, k))
        return pa.concat_tables(parts) if parts else best_of_block(left.slice(0, 0), right.slice(0, 0), width, k)

    left = asked.withColumn("cell", cell).repartition(cells, "cell")
    right = held.withColumn("cell", cell).repartition(cells, "cell")
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, FOUND)


def _sorted(table: pa.Table) -> dict[tuple[int, int], pa.Array]:
    """The rows of each (bucket, block)."""
    bucket, block = table["bucket"].to_numpy(), table["block"].to_numpy()
    order = np.lexsort((block, bucket))
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(block[order]) != 0)])) if len(order) else []
    ends = [*list(edges)[1:], len(order)]
    return {(int(bucket[order[a]]), int(block[order[a]])): pa.array(order[a:b]) for a, b in zip(edges, ends, strict=True)} if len(order) else {}


def search(vectors: DataFrame, is_query: str | Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST,
           tables: int = TABLES, probes: int = PROBES, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row (``is_query`` over ``vec_id``)."""
    rows, width = usable(vectors, vec_id, vector)
    spark = vectors.sparkSession
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = F.expr(is_query) if isinstance(is_query, str) else is_query
    held = hashed(rows, width, tables, 1, seed).select("vec_id", "v", F.explode("buckets").alias("bucket"))
    # At most tables times twice the padded dimension rows.
    sizes = held.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)
    dealt = held.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
    queries = hashed(rows.filter(chosen), width, tables, probes, seed).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("buckets").alias("bucket"))
    asked = queries.join(sizes, "bucket").select("query_id", "q", "bucket", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    total = rows.select("vec_id").distinct().count()
    found = stage(in_blocks(asked, dealt, width, k, partitions_for(spark, total * tables, CELL_ROWS)), "neighbours")
    counted = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    ids = rows.filter(chosen)
    short = ids.join(counted, ids["vec_id"] == counted["query_id"], "left").filter(
        F.coalesce("n", F.lit(0)) < min(k, total - 1)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks = max(1, -(-total // block_rows))
    everyone = rows.select("vec_id", "v", F.lit(-1).cast("long").alias("bucket"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    again = short.select("query_id", "q", F.lit(-1).cast("long").alias("bucket"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    rest = in_blocks(again, everyone, width, k, partitions_for(spark, total, CELL_ROWS)) if not short.isEmpty() else None
    return best(found if rest is None else found.unionByName(rest), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int = NEAREST) -> dict[int, list[int]]:
    """Each query's ``k`` nearest over all rows; for tests and recall."""
    out = {}
    for q in queries.tolist():
        own = int(np.flatnonzero(ids == q)[0])
        score = vectors @ vectors[own]
        order = np.lexsort((ids, -score))
        out[q] = [int(i) for i in ids[order] if i != q][:k]
    return out
