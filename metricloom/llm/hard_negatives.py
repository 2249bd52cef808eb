"""Hard-negative mining with score bounds along spanning trees of anchors.

A row's score is the integer inner product of its vector with the anchor's, of components ``floor(scale * x)``.
An anchor's positives are its best rows of the same label. For each positive the negatives are the best
rows of other labels with scores in a window below the positive's score.

Anchors are dealt into blocks, and each block gets a spanning tree of the smallest edges. A candidate
is scored at the root. From a parent to a child its score moves by at most the edge's length times the
candidate's norm, so the parent's score, or its bounds, bound the child's. Only candidates whose bounds
overlap a window of the child that is still open are scored again. The window of the positives begins at
the k-th best found so far, that of the negatives lies below the positive's score. Bounds are exact: whatever
they rule out could not have been returned.

Every block of anchors meets all rows, dealt into at most ``GROUPS`` streams by hash. A task holds a block
and its best rows so far, and reads its stream batch by batch, so memory does not grow with the stream and a
block emits at most ``GROUPS`` lists for each anchor, however many rows there are. Labels
and ids do not decide where rows go, so no label or id is hot.

Defined results: rows with a null id, a null label, a null or empty vector, or a null or non-finite component (or
one beyond 2**31 after scaling) take no part. Equal rows count once; rows of one id that differ
are rows of their own, and several anchors if the id is an anchor's. A row with the anchor's own id is neither positive
nor negative for it. Rows whose vectors have another length do not meet. Anchors without positives, and
positives without negatives, give no rows. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.storage import stage

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: The smallest negative score in percent of the positive's.
LEAST = 80
ANCHORS, GROUPS, GROUP_ROWS, BATCH = 1024, 32, 2048, 2048
LOWEST = np.iinfo(np.int64).min
OUT = "block long, place int, slot int, vec_id long, score long"


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, v, width`` of the distinct rows that take part; ``v`` are the scaled components."""
    plain = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
                           F.col(f"`{vector}`").cast("array<double>").alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < 2.0**31))
    plain = plain.filter("vec_id is not null and label is not null and x is not null").filter((F.size("x") > 0) & F.coalesce(good, F.lit(False)))
    v = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("int"))
    return plain.select("vec_id", "label", v.alias("v")).distinct().withColumn("width", F.size("v"))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points in an order in which parents come first, each one's parent (a place of that order, -1 at first) and edge length."""
    n = len(points)
    x = points.astype(np.float64)
    near = np.full(n, np.inf)
    by = np.full(n, -1)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    new = 0
    for place in range(n):
        order[place], parent[place], edge[place] = new, by[new], 0.0 if place == 0 else near[new]
        apart = x - x[new]
        d = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        closer = d < near
        near[closer], by[closer] = d[closer], place
        near[order[:place + 1]] = np.inf
        by_now = np.ones(n, bool)
        by_now[order[:place + 1]] = False
        if place + 1 < n:
            new = int(np.flatnonzero(by_now)[np.argmin(near[by_now])])
    return order, parent, edge


def with_trees(anchors: DataFrame, blocks: int) -> DataFrame:
    """``block, place, parent, edge`` and the anchor, parents before children in each block."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("label", "ascending")]).combine_chunks()
        x = matrix(rows["v"])
        # Equal ids and labels: by the vectors, so that a rerun gives the same tree.
        rows = rows.take(pa.array(np.lexsort((*x.T[::-1], rows["label"].to_numpy(), rows["vec_id"].to_numpy()))))
        order, parent, edge = spanning_tree(matrix(rows["v"]))
        rows = rows.take(pa.array(order))
        return pa.table([rows["block"], pa.array(np.arange(len(order)), pa.int32()), pa.array(parent, pa.int32()), pa.array(edge),
                         rows["vec_id"], rows["label"], rows["v"]], names=["block", "place", "parent", "edge", "vec_id", "label", "v"])

    dealt = anchors.withColumn("block", F.col("width").cast("long") * blocks + F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(
        run, "block long, place int, parent int, edge double, vec_id long, label long, v array<int>")


class Walk:
    """One block of anchors, down whose tree batches of candidates go.

    ``tops`` holds the upper ends of each anchor's windows. Without any, the rows of the anchor's own label with the
    best scores are looked for, otherwise rows of other labels inside the windows.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, parent: np.ndarray, edge: np.ndarray,
                 tops: list[np.ndarray] | None, k: int, least: int):
        self.ids, self.labels, self.points, self.parent, self.edge = ids, labels, points, parent.tolist(), edge.tolist()
        self.tops, self.k = tops, k
        self.bottoms = None if tops is None else [-(-least * t // 100) for t in tops]
        slots = 1 if tops is None else max(map(len, tops), default=0)
        self.best: list[list[tuple[np.ndarray, np.ndarray]]] = [
            [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(1 if tops is None else len(tops[a]))] for a in range(len(ids))]
        self.slots = slots
        #: (anchor, candidate) pairs met and scored, the root's left out.
        self.met = self.scored = 0

    def bar(self, anchor: int, slot: int) -> int:
        scores = self.best[anchor][slot][0]
        return int(scores[-1]) if len(scores) == self.k else LOWEST

    def keep(self, anchor: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old_scores, old_ids = self.best[anchor][slot]
        scores, ids = np.concatenate([old_scores, scores]), np.concatenate([old_ids, ids])
        first = np.lexsort((ids, -scores))[:self.k]
        self.best[anchor][slot] = scores[first], ids[first]

    def wanted(self, anchor: int, low: np.ndarray, high: np.ndarray, others: np.ndarray) -> np.ndarray:
        if self.tops is None:
            bar = self.bar(anchor, 0)
            if bar == LOWEST and np.count_nonzero(others) >= self.k:
                # The lower ends of k candidates are a bar before any of them is scored.
                bar = np.partition(low[others], -self.k)[-self.k]
            return others & (high >= bar)
        inside = np.zeros(len(low), bool)
        for slot, (bottom, top) in enumerate(zip(self.bottoms[anchor].tolist(), self.tops[anchor].tolist(), strict=True)):
            if bottom <= top:
                inside |= (high >= max(bottom, self.bar(anchor, slot))) & (low <= top)
        return others & inside

    def feed(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> None:
        norms = np.sqrt(np.einsum("ij,ij->i", points.astype(np.float64), points.astype(np.float64))) * (1 + 1e-9)
        lows, highs = np.empty((len(self.ids), len(ids)), np.int64), np.empty((len(self.ids), len(ids)), np.int64)
        for a, (parent, edge) in enumerate(zip(self.parent, self.edge, strict=True)):
            if parent < 0:
                low = high = np.einsum("ij,j->i", points, self.points[a])
                lows[a] = highs[a] = low
                low, high = lows[a], highs[a]
            else:
                moved = np.floor(edge * norms).astype(np.int64)
                low, high = lows[a], highs[a]
                np.subtract(lows[parent], moved, out=low)
                np.add(highs[parent], moved, out=high)
            others = (labels == self.labels[a]) if self.tops is None else (labels != self.labels[a])
            others &= ids != self.ids[a]
            at = np.flatnonzero(self.wanted(a, low, high, others))
            if parent >= 0:
                self.met += len(ids)
                open_ = at[low[at] < high[at]]
                if len(open_):
                    self.scored += len(open_)
                    low[open_] = high[open_] = np.einsum("ij,j->i", points[open_], self.points[a])
            if len(at):
                score = low[at]
                if self.tops is None:
                    on = score >= self.bar(a, 0)
                    if on.any():
                        self.keep(a, 0, score[on], ids[at[on]])
                    continue
                for slot, (bottom, top) in enumerate(zip(self.bottoms[a].tolist(), self.tops[a].tolist(), strict=True)):
                    on = (score >= max(bottom, self.bar(a, slot))) & (score <= top)
                    if on.any():
                        self.keep(a, slot, score[on], ids[at[on]])

    def found(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Places, slots, ids and scores."""
        out: tuple[list[int], ...] = ([], [], [], [])
        for a, lists in enumerate(self.best):
            for slot, (scores, ids) in enumerate(lists):
                for column, values in zip(out, ([a] * len(ids), [slot] * len(ids), ids.tolist(), scores.tolist()), strict=True):
                    column.extend(values)
        return out


def matched(trees: DataFrame, rows: DataFrame, blocks: int, groups: int, *, tops: bool, k: int, least: int) -> DataFrame:
    """``block, place, slot, vec_id, score``: the best of each stream for each anchor; ``trees`` has ``tops`` if asked for."""
    first = trees.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "place", "parent", "edge", "vec_id",
                         "label", "v", F.col("tops") if tops else F.array().cast("array<long>").alias("tops"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    nothing = F.lit(None)
    dealt = rows.select("*", block.alias("b")).select(
        (F.col("width").cast("long") * blocks + F.col("b")).alias("block"), F.pmod(F.xxhash64("label", "vec_id", "v"), F.lit(groups)).cast("int").alias("group"),
        F.lit(-1).alias("place"), nothing.cast("int").alias("parent"), nothing.cast("double").alias("edge"), "vec_id", "label", "v",
        nothing.cast("array<long>").alias("tops"))
    both = first.union(dealt).withColumn("last", F.col("place") < 0)
    streams = both.repartition(blocks * groups, "block", "group").sortWithinPartitions("block", "group", "last", "place").drop("last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, key, anchors = None, None, []

        def done() -> pa.RecordBatch:
            place, slot, ids, scores = walk.found()
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array(slot, pa.int32()),
                pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["block", "place", "slot", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block, group, place = (batch.column(c).to_numpy() for c in range(3))
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(group) != 0) | ((place[:-1] < 0) != (place[1:] < 0))) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part, here = batch.slice(a, b - a), (int(block[a]), int(group[a]))
                if here != key:
                    if walk is not None:
                        yield done()
                    walk, key, anchors = None, here, []
                if place[a] >= 0:
                    anchors.append(part)
                    continue
                if walk is None:
                    if not anchors:
                        # Rows of a length that no anchor of the block has.
                        continue
                    held = pa.Table.from_batches(anchors).combine_chunks()
                    lists = [np.array(t, np.int64) for t in held["tops"].to_pylist()] if tops else None
                    walk = Walk(held["vec_id"].to_numpy(), held["label"].to_numpy(), matrix(held["v"]), held["parent"].to_numpy(),
                                held["edge"].to_numpy(), lists, k, least)
                for i in range(0, part.num_rows, BATCH):
                    rows = part.slice(i, BATCH)
                    walk.feed(rows.column(5).to_numpy(), rows.column(6).to_numpy(), matrix(rows.column(7)))
        if walk is not None:
            yield done()

    return streams.mapInArrow(run, OUT)


def mine(vectors: DataFrame, is_anchor: str | Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE, anchors_per_block: int = ANCHORS,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``is_anchor`` is over ``vec_id``."""
    rows = stage(whole_numbers(vectors, vec_id, vector, label, scale), "negatives-rows")
    chosen = rows.filter(F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor)
    blocks = max(1, -(-chosen.count() // anchors_per_block))
    groups = min(GROUPS, max(1, -(-rows.count() // group_rows)))
    trees = stage(with_trees(chosen, blocks), "negatives-trees")
    near = matched(trees, rows, blocks, groups, tops=False, k=positives, least=least)
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("slot", F.row_number().over(best) - 1).filter(F.col("slot") < positives)
    near = stage(near.select("block", "place", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                 "negatives-positives")
    tops = near.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("t")).select(
        "block", "place", F.col("t.positive_score").alias("tops"))
    windows = stage(trees.join(tops, ["block", "place"], "left").withColumn("tops", F.coalesce("tops", F.array().cast("array<long>"))), "negatives-windows")
    found = matched(windows, rows, blocks, groups, tops=True, k=negatives, least=least)
    order = Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    anchors = trees.select("block", "place", F.col("vec_id").alias("anchor_id"))
    return found.join(near, ["block", "place", "slot"]).join(anchors, ["block", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def brute_force(rows: list[tuple], positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
                scale: int = SCALE, every: int = 100) -> list[tuple]:
    """The result over all pairs of (vec_id, vector, label); for tests."""
    import math

    good = []
    for i, x, y in rows:
        if i is None or y is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = (i, y, tuple(math.floor(scale * c) for c in x))
        if row not in good:
            good.append(row)
    out = []
    for a, y, x in good:
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, v, strict=True)), i, y == z) for i, z, v in good if i != a and len(v) == len(x)]
        for s, p, _ in sorted(t for t in scores if t[2])[:positives]:
            inside = sorted(t for t in scores if not t[2] and least * -s <= 100 * -t[0] <= 100 * -s)[:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside, 1)]
    return out
