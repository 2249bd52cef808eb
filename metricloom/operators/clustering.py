"""Exact silhouette per bucket.

Mean distances to whole clusters need every pair of a bucket, but the pairs are
never rows. Points are hashed into blocks of bounded bytes, each task receives
two blocks, and what leaves it is one row per point with its partial sums for the other side's clusters, for the points
of both: a pair of blocks is looked at once. A block is sent to half of the other blocks, those after it
round the circle. ``sample`` trades exactness for time on request only; it keeps points by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.timebuckets import bucket_start

#: Points and bytes of features that a block has at most, on average. Copies and partial sums fall as blocks grow.
BLOCK_POINTS, BLOCK_BYTES = 8192, 2 << 20
#: Bytes of a distance matrix handled at once.
CHUNK_BYTES = 2 << 20
#: Squared distances below this share of both squared lengths are computed again from differences.
CLOSE = 1e-6
PARTIAL = "group_id string, row_id string, other array<string>, distance array<double>, n array<long>"


def _kernel():
    """The task function, built here so that it travels to the workers with its helpers."""

    def distances(a: np.ndarray, b: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
        lengths = aa[:, None] + bb[None, :]
        square = lengths - 2 * (a @ b.T)
        i, j = np.nonzero(square <= CLOSE * lengths)
        step = max(1, CHUNK_BYTES // (8 * max(1, a.shape[1])))
        for k in range(0, len(i), step):
            apart = a[i[k:k + step]] - b[j[k:k + step]]
            square[i[k:k + step], j[k:k + step]] = np.einsum("ij,ij->i", apart, apart)
        return np.sqrt(square)

    def both_sums(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, same: bool):
        """Sums and counts of distances: of each left point to the right clusters, and of each right point to the left ones."""
        aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        out = [np.zeros((len(a), in_b.shape[1])), np.zeros((len(a), in_b.shape[1])),
               np.zeros((len(b), in_a.shape[1])), np.zeros((len(b), in_a.shape[1]))]
        step = max(1, CHUNK_BYTES // (8 * len(b)))
        for k in range(0, len(a), step):
            part = slice(k, k + step)
            far = distances(a[part], b, aa[part], bb)
            # A NULL feature makes the distance unknown; unknown distances are left out of the means.
            usable = ~np.isnan(far)
            if same:
                usable[np.arange(len(far)), k + np.arange(len(far))] = False
            far, usable = np.where(usable, far, 0.0), usable.astype(np.float64)
            out[0][part], out[1][part] = far @ in_b, usable @ in_b
            if not same:
                out[2] += far.T @ in_a[part]
                out[3] += usable.T @ in_a[part]
        return out

    def table(group: str, ids: pa.Array, clusters: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        points, others = counts.shape
        ends = pa.array(np.arange(points + 1, dtype=np.int32) * others)
        names = pa.array(clusters, pa.string()).take(pa.array(np.tile(np.arange(others), points)))
        return pa.RecordBatch.from_arrays([
            pa.array([group] * points, pa.string()), ids, pa.ListArray.from_arrays(ends, names),
            pa.ListArray.from_arrays(ends, pa.array(sums.ravel())),
            pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64).ravel()))],
            ["group_id", "row_id", "other", "distance", "n"])

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                sides = []
                for side in ("left", "right"):
                    ids = column[f"{side}_ids"][r].values
                    names, codes = np.unique(np.array(column[f"{side}_clusters"][r].values.to_pylist(), dtype=object), return_inverse=True)
                    x = column[f"{side}_features"][r].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    sides.append((ids, names, np.eye(len(names))[codes], x))
                (ids, names, member, a), (other_ids, other_names, other_member, b) = sides
                same = column["same"][r].as_py()
                # Distances do not change with the origin, and small coordinates lose fewer digits.
                known = a[~np.isnan(a).any(axis=1)]
                centre = known.mean(axis=0) if len(known) else 0.0
                sums, counts, back, back_counts = both_sums(a - centre, b - centre, member, other_member, same)
                group = column["group_id"][r].as_py()
                yield table(group, ids, other_names, sums, counts)
                if not same:
                    yield table(group, other_ids, names, back, back_counts)
            # The next batch comes without this one beside it.
            batch = column = sides = ids = other_ids = x = a = b = known = None

    return partial_sums


def hash_sample(row_id: Column, fraction: float, seed: int) -> Column:
    """True for about ``fraction`` of all ids, always the same ones."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") < F.lit(int(fraction * 2**32))


def silhouette(df: DataFrame, *, ts: str, row_id: str, cluster: str, features: str | Sequence[str],
               bucket: str = "1 day", group_by: Sequence[str] = (), sample: float | None = None, seed: int = 42,
               block_points: int = BLOCK_POINTS) -> DataFrame:
    """cluster_silhouette per (bucket, cluster) and silhouette_score per bucket.

    ``features`` is an array column or a list of scalar columns. Single points and
    buckets with one cluster score 0. ``row_id`` is unique within a bucket.
    """
    keys = ["bucket", *group_by]
    if isinstance(features, str):
        vector, needed = F.col(features).cast("array<double>"), [ts, cluster, features]
    else:
        vector, needed = F.array(*[F.col(c).cast("double") for c in features]), [ts, cluster]
    rows = df.dropna(subset=needed)
    if sample is not None:
        rows = rows.filter(hash_sample(F.col(row_id), sample, seed))
    points = rows.select(
        group_key_of(ts, bucket, group_by).alias("_g"),
        F.col(row_id).cast("string").alias("row_id"),
        F.col(cluster).cast("string").alias("cluster"),
        F.transform(vector, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("features"),
    ).withColumn("group_id", F.to_json("_g"))
    blocks = feature_blocks(points, block_points)
    block_pairs = paired(blocks)
    partial = block_pairs.mapInArrow(_kernel(), PARTIAL)
    # A point's sums travel as one row and are unfolded where they are added up. Without an id no point can take them.
    together = partial.filter("row_id is not null").repartition("group_id", "row_id")
    sums = together.select("group_id", "row_id", F.inline(F.arrays_zip("other", "distance", "n"))).filter("n > 0")
    means = sums.groupBy("group_id", "row_id", "other").agg((F.sum("distance") / F.sum("n")).alias("mean"))
    scored = points.select("group_id", "_g", "row_id", "cluster").join(means, ["group_id", "row_id"], "left")
    own = F.col("other") == F.col("cluster")
    per_point = scored.groupBy("group_id", "_g", "row_id", "cluster").agg(
        F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b")
    )
    worst = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (worst == 0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / worst
    )
    per_cluster = (
        per_point.groupBy("group_id", "_g", F.col("cluster").alias("series"))
        .agg(F.sum(score).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    )
    overall = per_cluster.groupBy("group_id").agg((F.sum("_sum") / F.sum("_n")).alias("silhouette_score"))
    return (
        per_cluster.join(overall, "group_id")
        .select(
            *[F.col("_g")[k].alias(k) for k in keys], "series",
            (F.col("_sum") / F.col("_n")).alias("cluster_silhouette"), "silhouette_score",
        )
        .orderBy(*keys, "series")
    )


def feature_blocks(points: DataFrame, block_points: int) -> DataFrame:
    """``group_id, _block, _blocks, ids, clusters, features``: the points of each block in arrays."""
    per_block = F.least(F.lit(block_points), F.greatest(F.lit(1), F.floor(BLOCK_BYTES / (8 * F.greatest(F.lit(1), F.max(F.size("features")))))))
    sizes = points.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("_blocks"))
    placed = points.join(sizes, "group_id").withColumn("_block", F.pmod(F.xxhash64("row_id"), F.col("_blocks")).cast("int"))
    return placed.groupBy("group_id", "_block", "_blocks").agg(F.collect_list(F.struct("row_id", "cluster", "features")).alias("p")).select(
        "group_id", "_block", "_blocks", F.col("p.row_id").alias("ids"), F.col("p.cluster").alias("clusters"),
        F.flatten("p.features").alias("features"))


def paired(blocks: DataFrame) -> DataFrame:
    """Each unordered pair of a group's blocks once, a block with itself included; a block is copied at most ``_blocks / 2 + 1`` times."""
    step = F.explode(F.sequence(F.lit(0), F.floor(F.col("_blocks") / 2).cast("int"))).alias("_step")
    left = blocks.select("group_id", "_block", "_blocks", *[F.col(c).alias(f"left_{c}") for c in ("ids", "clusters", "features")], step)
    # Across an even circle two blocks face each other: the first one asks.
    left = left.filter((F.col("_step") == 0) | (2 * F.col("_step") < F.col("_blocks")) | (F.col("_block") < F.col("_step")))
    left = left.withColumn("_block", F.pmod(F.col("_block") + F.col("_step"), F.col("_blocks")))
    right = blocks.select("group_id", "_block", *[F.col(c).alias(f"right_{c}") for c in ("ids", "clusters", "features")])
    return left.join(right, ["group_id", "_block"]).withColumn("same", F.col("_step") == 0).drop("_block", "_blocks", "_step")


def group_key_of(ts: str, bucket: str, group_by: Sequence[str]):
    return F.struct(bucket_start(ts, bucket).alias("bucket"), *group_by)
