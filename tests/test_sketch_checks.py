from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import sketches
from metricloom.operators import clustering, sketch_checks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [("hot", float(v)) for v in rng.lognormal(size=20_000)] + [("tied", float(v)) for v in rng.integers(0, 4, 3000)]
    data += [("one", 7.0), ("none", None), (None, 1.0), (None, 2.0), (None, 3.0)]
    return spark.createDataFrame(data, "g string, v double").repartition(7)


Q = {"p01": 0.01, "median": 0.5, "p95": 0.95}


def merged(rows):
    parts = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(20))).groupBy("g", "part").agg(sketches.build("v").alias("s"))
    return parts.groupBy("g").agg(sketches.merge("s").alias("s"))


def test_bands_are_exact_ranks(rows):
    gap = sketch_checks.allowed()
    assert 0.02 < gap < 0.03 and sketch_checks.rank_error(mass=True) > sketch_checks.rank_error()
    out = {r.g: r for r in sketch_checks.quantile_bands(rows, ["g"], "v", Q).collect()}
    assert set(out) == {"hot", "tied", "one", None}
    for g in out:
        vs = sorted(r.v for r in rows.filter(F.col("g").eqNullSafe(g) & F.col("v").isNotNull()).collect())
        n = len(vs)
        assert out[g].n == n
        for name, q in Q.items():
            low, high = max(0, int(np.floor((q - gap) * n)) - 1), min(n - 1, int(np.ceil((q + gap) * n)))
            assert (out[g][f"{name}_low"], out[g][f"{name}_high"]) == (vs[low], vs[high])


def test_true_sketches_hold_and_wrong_ones_do_not(rows):
    good = sketch_checks.held_quantiles(rows, merged(rows), ["g"], "v", Q).collect()
    assert all(r[f"{name}_held"] for r in good for name in Q)
    # Another series, a part of the rows, and no sketch at all.
    shifted = merged(rows.withColumn("v", F.col("v") * 1.5))
    assert not any(r.median_held for r in sketch_checks.held_quantiles(rows, shifted, ["g"], "v", Q).collect() if r.g in ("hot", "one"))
    part = merged(rows.filter("g <> 'hot' or v < 1"))
    assert not any(r.p95_held for r in sketch_checks.held_quantiles(rows, part, ["g"], "v", Q).collect() if r.g in ("hot", None))


def exact(values, q):
    vs, gap = np.sort(values), sketch_checks.allowed()
    n = len(vs)
    low, high = max(0, int(np.floor((q - gap) * n)) - 1), min(n - 1, int(np.ceil((q + gap) * n)))
    return repr((float(vs[low]), float(vs[high])))


def test_only_values_near_the_ranks_are_ordered(rows, monkeypatch):
    ordered, totals = [], sketch_checks.running_totals
    monkeypatch.setattr(sketch_checks, "running_totals", lambda df, *a, **k: ordered.append(df.filter("g = 'hot'").count()) or totals(df, *a, **k))
    quantiles = {"median": 0.5, "p95": 0.95}
    out = sketch_checks.held_quantiles(rows, merged(rows), ["g"], "v", quantiles).filter("g = 'hot'").first()
    # A fifth of the values lies as near to the ranks as the error allows, and is ordered once.
    assert len(ordered) == 1 and 2000 < ordered[0] < 6000
    values = [r.v for r in rows.filter("g = 'hot'").collect()]
    assert all(repr((out[f"{name}_low"], out[f"{name}_high"])) == exact(values, q) for name, q in quantiles.items())


def test_bands_do_not_depend_on_the_sketch(spark):
    rng = np.random.default_rng(4)
    groups = {"a": [*rng.normal(size=3000), *[0.0, -0.0] * 900], "b": [*rng.normal(size=1500), *[float("inf"), float("nan"), float("-inf")] * 200],
              None: [float(v) for v in rng.integers(0, 9, 2000)], "small": list(rng.normal(size=sketch_checks.MARKED_ROWS - 1))}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    true = rows.groupBy("g").agg(sketches.build("v").alias("s"))
    wrong = rows.groupBy("g").agg(sketches.build(F.col("v") * 0.01 + 1).alias("s"))
    partly = wrong.filter("g = 'a'").unionByName(true.filter("g = 'b'"))
    for given in (None, wrong, partly.unionByName(true)):
        out = {r.g: r for r in sketch_checks.quantile_bands(rows, ["g"], "v", Q, merged=given).collect()}
        assert {g: r.n for g, r in out.items()} == {g: len(vs) for g, vs in groups.items()}
        for g, vs in groups.items():
            for name, q in Q.items():
                low, high = (v + 0.0 for v in (out[g][f"{name}_low"], out[g][f"{name}_high"]))
                assert repr((low, high)) == exact(np.array(vs) + 0.0, q), (g, name)
    every = [v for vs in groups.values() for v in vs]
    whole = sketch_checks.quantile_bands(rows, [], "v", {"p30": 0.3}).collect()
    assert [(r.n, repr((r.p30_low, r.p30_high))) for r in whole] == [(len(every), exact(np.array(every) + 0.0, 0.3))]
    assert sketch_checks.quantile_bands(rows.filter("v > 1e9 and v < 2e9"), ["g"], "v", Q).collect() == []


def test_mass_between_points(rows):
    whole = rows.agg(sketches.build("v").alias("s"))
    points = [0.0, 0.5, 1.0, 2.0, 1000.0]
    out = sorted(sketch_checks.mass_table(rows, whole, "v", points).collect(), key=lambda r: r.pos)
    vs = np.array([r.v for r in rows.filter("v is not null").collect()])
    edges = [-np.inf, *points, np.inf]
    assert [r.exact_count for r in out] == [int(((vs > a) & (vs <= b)).sum()) for a, b in zip(edges, edges[1:], strict=False)]
    assert all(r.held and r.n == len(vs) for r in out)
    other = rows.withColumn("v", F.col("v") + 0.3).agg(sketches.build("v").alias("s"))
    assert not all(r.held for r in sketch_checks.mass_table(rows, other, "v", points).collect())


def test_sample_is_the_same_in_every_order(spark):
    ids = spark.range(20_000)
    kept = {r.id for r in ids.filter(clustering.hash_sample(F.col("id"), 0.3, 1)).collect()}
    assert kept == {r.id for r in ids.orderBy(F.desc("id")).repartition(3).filter(clustering.hash_sample(F.col("id"), 0.3, 1)).collect()}
    assert abs(len(kept) / 20_000 - 0.3) < 0.02
    assert kept != {r.id for r in ids.filter(clustering.hash_sample(F.col("id"), 0.3, 2)).collect()}
    assert ids.filter(clustering.hash_sample(F.col("id"), 1.0, 1)).count() == 20_000
