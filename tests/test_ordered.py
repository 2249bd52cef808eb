from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import clustering, ordered, rank, timeseries
from tests.conftest import day


def test_blocks_never_decrease(spark):
    values = [None, float("-inf"), -1e300, -2.0, -1.0000001, -1.0, -1e-308, -0.0, 0.0, 5e-324, 0.25, 0.9999, 1.0, 3.7,
              1e308, float("inf"), float("nan")]
    marks = [[], [0.0], [-2.0, 0.25], [-1e300, -1.0, 0.0, 1.0, 3.7], sorted(v for v in values if v is not None and v == v)]
    df = spark.createDataFrame([(i, j, v, m) for i, v in enumerate(values) for j, m in enumerate(marks)],
                               "i int, j int, v double, m array<double>")
    for j, m in enumerate(marks):
        blocks = [r[0] for r in df.filter(F.col("j") == j).orderBy("i").select(ordered.block_of(F.col("v"), F.col("m"))).collect()]
        assert blocks == sorted(blocks)
        assert blocks == [-1 if v is None else len(m) if v != v else sum(x <= v for x in m) for v in values]


@pytest.mark.parametrize("values", ["scores", "milliseconds", "heavy tail"])
def test_blocks_follow_the_data(spark, values):
    """A million values of a narrow range, of one day, or of all magnitudes fill blocks of about the same size."""
    n = 1_000_000
    i = F.col("id")
    value = {"scores": F.lit(0.9994) + i * F.lit(0.0006 / n), "milliseconds": F.lit(1.7e12) + i * 86.4,
             "heavy tail": F.exp(i / 2000.0)}[values]
    rows = spark.range(n).select(F.when(i % 3 < 2, "hot").otherwise("other").alias("g"), value.alias("v"), F.lit(1).cast("long").alias("n"))
    rows = rows.filter(~F.isnan("v") & (F.abs("v") < float("inf"))).distinct()
    total = rows.filter("g = 'hot'").count()
    sizes = [r[0] for r in ordered.with_blocks(rows, ["g"], "v", 8192).filter("g = 'hot'").groupBy("_block").count().select("count").collect()]
    # Gaps between chosen values are geometric: none of some eighty exceeds ten times the mean but by odds of one to hundreds.
    assert sum(sizes) == total and len(sizes) > total / 8192 / 2 and max(sizes) < 10 * 8192


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_many_blocks(spark, descending):
    rng = random.Random(9)
    rows = [(g, v, rng.randint(0, 9)) for g, n in (("a", 900), ("b", 3), (None, 400)) for v in {round(rng.gauss(0, 1), 4) for _ in range(n)}]
    rows += [("a", None, 4), ("a", float("nan"), 5)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    out = ordered.running_totals(df, ["g"], "v", ["n"], descending=descending, block_rows=20).collect()
    assert len(out) == len(rows)
    for g in ("a", "b", None):
        part = sorted((r for r in out if r["g"] == g), key=lambda r: (r["v"] is not None, r["v"] != r["v"], r["v"] or 0), reverse=descending)
        assert [r["cum_n"] for r in part] == list(np.cumsum([r["n"] for r in part]))
        assert {r["total_n"] for r in part} == {sum(r["n"] for r in part)}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_null_groups(spark, descending):
    rng = random.Random(1)
    rows = [(g, v, rng.randint(1, 9)) for g in ("a", None) for v in rng.sample(range(-500, 500), 200)]
    df = spark.createDataFrame([(g, v / 7, n) for g, v, n in rows], "g string, v double, n long")
    out = ordered.running_totals(df, ["g"], "v", ["n"], descending=descending).collect()
    assert len(out) == 400
    for g in ("a", None):
        part = sorted((r for r in out if r["g"] == g), key=lambda r: r["v"], reverse=descending)
        assert [r["cum_n"] for r in part] == list(np.cumsum([r["n"] for r in part]))
        assert {r["total_n"] for r in part} == {sum(r["n"] for r in part)}


def test_exact_quantiles_match_numpy_on_a_skewed_group(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.lognormal(size=3000), 2), "one": np.array([4.0]), "two": np.array([-1.0, 3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None)],
                               "g string, v double")
    out = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95},
                                                      sums={"total": "v"}).collect()}
    for g, vs in groups.items():
        for name, q in (("p10", 10), ("p50", 50), ("p95", 95)):
            assert out[g][name] == pytest.approx(np.percentile(vs, q))
        assert out[g]["n"] == len(vs) and out[g]["total"] == pytest.approx(vs.sum())


@pytest.mark.parametrize("n", [3, 10, 47])
def test_weighted_tiles_match_ntile(spark, n):
    rng = random.Random(n)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "p double, y int")
    df.createOrReplaceTempView("tile_rows")
    expected = spark.sql("SELECT tile, p, y, count(*) FROM (SELECT ntile(10) OVER (ORDER BY p, y) AS tile, p, y "
                         "FROM tile_rows) GROUP BY ALL").collect()
    counts = df.groupBy("p", "y").agg(F.count(F.lit(1)).alias("n"))
    got = ordered.weighted_tiles(counts, [], "p", "n", 10, tie_break=["y"]).select("tile", "p", "y", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def brute_kendall(x, y):
    c = d = 0
    for i in range(len(x)):
        for j in range(i):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            c, d = c + (s > 0), d + (s < 0)
    return (c - d) / (c + d) if c + d else 0.0


def brute_spearman(x, y):
    ranks = [np.array([1 + np.sum(v < w) for w in v], dtype=float) for v in (np.array(x), np.array(y))]
    return float(np.corrcoef(*ranks)[0, 1]) if min(r.std() for r in ranks) > 0 else 0.0


def test_rank_correlation_matches_all_pairs(spark):
    rng = random.Random(5)
    groups = {
        1: [(rng.gauss(0, 3), rng.randint(-5, 5)) for _ in range(150)],
        2: [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(60)],
        3: [(1.0, 2.0)],
        4: [(7.0, float(i)) for i in range(5)],
        5: [(float(i), -float(i) ** 3) for i in range(40)],
    }
    df = spark.createDataFrame(
        [(day(g), float(x), float(y)) for g, rows in groups.items() for x, y in rows] + [(day(1), None, 1.0)],
        "ts timestamp, x double, y double",
    )
    out = {r["bucket"].day: r for r in rank.rank_association(df, ts="ts", x="x", y="y").collect()}
    assert set(out) == set(groups)
    for g, rows in groups.items():
        x, y = zip(*rows)
        assert out[g]["kendall_tau"] == pytest.approx(brute_kendall(x, y)), g
        assert out[g]["spearman_rho"] == pytest.approx(brute_spearman(x, y)), g


def brute_silhouette(points):
    scores = []
    for i, (ci, vi) in enumerate(points):
        means = {}
        for c in {c for c, _ in points}:
            ds = [np.linalg.norm(np.subtract(vi, v)) for j, (cj, v) in enumerate(points) if cj == c and j != i]
            if ds:
                means[c] = np.mean(ds)
        a, others = means.pop(ci, None), list(means.values())
        scores.append(0.0 if a is None or not others or max(a, min(others)) == 0
                      else (min(others) - a) / max(a, min(others)))
    return scores


@pytest.mark.parametrize("as_columns", [False, True])
def test_silhouette_over_many_blocks(spark, as_columns):
    rng = np.random.default_rng(2)
    days = {
        1: [(str(c), rng.normal(c, 1, 3).tolist()) for c in (0, 1, 2) for _ in range(15)] + [("lonely", [9.0, 9.0, 9.0])],
        2: [("only", rng.normal(0, 1, 3).tolist()) for _ in range(5)],
        3: [("a", [0.0, 0.0, 0.0])],
    }
    rows = [(day(d), f"{d}-{i}", c, v, *v) for d, points in days.items() for i, (c, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "ts timestamp, id string, c string, v array<double>, v0 double, v1 double, v2 double")
    features = ["v0", "v1", "v2"] if as_columns else "v"
    out = clustering.silhouette(df, ts="ts", row_id="id", cluster="c", features=features, block_points=7).collect()
    for d, points in days.items():
        scores = brute_silhouette(points)
        part = [r for r in out if r["bucket"].day == d]
        assert {r["series"] for r in part} == {c for c, _ in points}
        for r in part:
            own = [s for s, (c, _) in zip(scores, points) if c == r["series"]]
            assert r["cluster_silhouette"] == pytest.approx(np.mean(own))
            assert r["silhouette_score"] == pytest.approx(np.mean(scores))


def test_blocks_meet_once_and_are_copied_to_half(spark):
    for n in (1, 2, 3, 6, 7):
        blocks = spark.range(n).select(F.lit("g").alias("group_id"), F.col("id").cast("int").alias("_block"), F.lit(n).alias("_blocks"),
                                       F.array(F.col("id").cast("string")).alias("ids"), F.array(F.lit("c")).alias("clusters"),
                                       F.array(F.col("id").cast("double")).alias("features"))
        pairs = [(r.left_ids[0], r.right_ids[0]) for r in clustering.paired(blocks).collect()]
        assert sorted(tuple(sorted(p)) for p in pairs) == sorted((str(i), str(j)) for i in range(n) for j in range(i, n))
        assert max(sum(p[0] == str(i) for p in pairs) for i in range(n)) <= n // 2 + 1


def test_wide_vectors_stay_within_their_budget(spark):
    """768 components, a thousand points: several blocks, and a task's working set far below 200 MB."""
    import tracemalloc

    rng = np.random.default_rng(4)
    rows = [(day(1), i, i % 3, (rng.normal(i % 3, 3, 768) + 1e4).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "ts timestamp, id long, c int, v array<double>")
    points = df.select(F.lit("g").alias("group_id"), F.col("id").cast("string").alias("row_id"), F.col("c").cast("string").alias("cluster"),
                       F.col("v").alias("features"))
    blocks = clustering.feature_blocks(points, clustering.BLOCK_POINTS)
    sizes = [len(r.ids) for r in blocks.select("ids").collect()]
    assert len(sizes) == 3 and max(sizes) * 768 * 8 < 2 * clustering.BLOCK_BYTES
    pair = clustering.paired(blocks).filter("not same").limit(1).toArrow().to_batches()
    tracemalloc.start()
    list(clustering._kernel()(iter(pair)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    out = clustering.silhouette(df, ts="ts", row_id="id", cluster="c", features="v").first()
    x, c = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    far = np.sqrt(((x[:, None, :64] - x[None, :, :64]) ** 2).sum(-1) + sum(
        ((x[:, None, k:k + 64] - x[None, :, k:k + 64]) ** 2).sum(-1) for k in range(64, 768, 64)))
    means = np.stack([far[:, c == k].sum(1) / ((c == k).sum() - (c == k)) for k in range(3)], 1)
    own = means[np.arange(900), c]
    other = np.where(np.eye(3, dtype=bool)[c], np.inf, means).min(1)
    assert out.silhouette_score == pytest.approx(np.mean((other - own) / np.maximum(own, other)), abs=1e-9)


def test_equal_and_close_points_keep_their_distances(spark):
    base = [1e6, -1e6, 5.0]
    points = [("a", base), ("a", base), ("b", [1e6 + 1e-3, -1e6, 5.0]), ("b", [1e6 + 2e-3, -1e6, 5.0]), ("c", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(day(1), i, c, v) for i, (c, v) in enumerate(points)], "ts timestamp, id long, c string, v array<double>")
    for block_points in (1, 2, 100):
        out = {r.series: r for r in clustering.silhouette(df, ts="ts", row_id="id", cluster="c", features="v", block_points=block_points).collect()}
        scores = brute_silhouette(points)
        assert out["a"].cluster_silhouette == pytest.approx(np.mean(scores[:2])) and out["b"].cluster_silhouette == pytest.approx(np.mean(scores[2:4]))


def test_trailing_sums_match_a_direct_count(spark):
    rng = random.Random(9)
    rows = [(k, day(1 + rng.randint(0, 20), rng.randint(0, 23)), rng.randint(1, 5)) for k in ("a", "b") for _ in range(80)]
    rows = list({(k, t): (k, t, n) for k, t, n in rows}.values())
    df = spark.createDataFrame(rows, "k string, t timestamp, n long")
    out = timeseries.trailing_sums(df, ["k"], "t", {"before": "n"}, span=7 * 86400).collect()
    assert len(out) == len(rows)
    for r in out:
        expected = sum(n for k, t, n in rows if k == r["k"] and 0 < (r["t"] - t).total_seconds() <= 7 * 86400)
        assert r["before"] == expected
