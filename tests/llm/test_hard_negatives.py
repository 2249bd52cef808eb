"""Hard negatives against brute force and SQL."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import hard_negatives, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def same(a, b):
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    df = queries.QUERIES["op12_hard_negatives"](spark, DATA)
    got = df.collect()
    assert got and dict(df.dtypes)["rank"] == "int"
    same(got, con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['op12_hard_negatives']})").fetchall())


@pytest.mark.parametrize("per_block, group_rows", [(2, 7), (1024, 2048)])
def test_equals_brute_force(spark, monkeypatch, per_block, group_rows):
    rnd, nan, inf = random.Random(6), float("nan"), float("inf")
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.1) for c in centres[rnd.randrange(4)]], rnd.randrange(3)) for i in range(0, 900, 3)]
    rows += [(100, [1.0] * 6, 1), (100, [1.0] * 6, 2), (200, [0.0] * 6, 1), (400, [-1.0] * 6, 0), (7, [1.0] * 6, 1), (7, [1.0] * 6, 1),
             (8, [1.0] * 6, 1), (10, [1.0] * 6, 2), (11, [1.0] * 6, 2), (None, [1.0] * 6, 1), (500, None, 1), (700, [1.0, nan], 1),
             (800, [1.0, None], 2), (1000, [inf] * 6, 1), (1100, [1.0] * 6, None), (1200, [2.0, 1.0], 1), (1201, [2.0, 1.0], 1),
             (1202, [1.0, 2.0], 0), (1203, [2.0, 0.9], 0), (1300, [], 1)]
    monkeypatch.setattr(hard_negatives, "BATCH", 5 if per_block == 2 else 2048)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "block": F.lit("x"), "score": F.lit(None).cast("int")}).repartition(3)
    got = hard_negatives.mine(df, "vec_id % 100 = 0", anchors_per_block=per_block, group_rows=group_rows).collect()
    want = hard_negatives.brute_force(rows)
    assert len(want) > 20
    same(got, want)
    assert hard_negatives.mine(df.limit(0), "vec_id % 100 = 0").count() == 0
    assert hard_negatives.mine(df, "vec_id < 0").count() == 0


def test_tree_is_minimal():
    points = np.random.default_rng(3).integers(-50, 50, (40, 4))
    points[7] = points[3]
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(40)) and parent[0] == -1 and all(p < i for i, p in enumerate(parent))
    for i in range(1, 40):
        assert abs(edge[i] - np.linalg.norm(points[order[i]] - points[order[parent[i]]])) < 1e-9
    # Kruskal's total.
    pairs = sorted((float(np.linalg.norm(points[i] - points[j])), i, j) for i in range(40) for j in range(i))
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for d, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert abs(total - edge.sum()) < 1e-6


def test_bounds_spare_most_scores():
    """Close anchors: most candidates are ruled out by their parent's score."""
    rng = np.random.default_rng(1)
    anchors = 1000 + rng.integers(-3, 4, (50, 8))
    points = rng.integers(-1000, 1000, (5000, 8))
    points[:40] = 1000 + rng.integers(-3, 4, (40, 8))
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    anchors = anchors[order]
    walk = hard_negatives.Walk(np.arange(50) + 10**6, np.zeros(50, np.int64), anchors, parent, edge, None, 5, 80)
    for i in range(0, 5000, 500):
        walk.feed(np.arange(i, i + 500), np.zeros(500, np.int64), points[i:i + 500])
    assert walk.scored < 0.1 * walk.met
    for a in range(50):
        scores = points @ anchors[a]
        assert walk.best[a][0][1].tolist() == np.lexsort((np.arange(5000), -scores))[:5].tolist()


def test_large_scores_stay_exact(spark):
    rows = [(0, [8e6, 3.0], 1), (1, [8e6, 4.0], 1), (2, [8e6, 1 / 256], 2), (3, [8e6, 0.0], 2), (4, [1e300, 0.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), "vec_id = 0").collect()
    same(got, hard_negatives.brute_force(rows[:4]))
