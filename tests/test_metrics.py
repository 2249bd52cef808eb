from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import binary, curves, drift, multilabel, operational, probability, quality, regression
from tests.conftest import day

SCORED = dict(ts="ts", label="label", score="score")
PAIR = dict(ts="ts", prediction="prediction", actual="actual")


def scored(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, label int, score double")


def pairs(spark, rows):
    return spark.createDataFrame([(day(1), float(p), float(a)) for p, a in rows],
                                 "ts timestamp, prediction double, actual double")


def test_threshold_counts_leave_out_nulls(spark):
    df = scored(spark, [(day(1), 1, 0.9), (day(1), 0, 0.5), (day(1), 0, 0.1), (day(1), 1, 0.2),
                        (day(1), None, 0.9), (day(1), 1, None), (day(2), None, None)])
    rows = {r["bucket"].day: r for r in binary.confusion_counts(df, threshold=0.5, **SCORED).collect()}
    assert tuple(rows[1])[1:] == (1.0, 1.0, 1.0, 1.0) and tuple(rows[2])[1:] == (0.0, 0.0, 0.0, 0.0)
    assert binary.negative_predictive_value(df, threshold=0.5, **SCORED).collect()[1]["npv"] is None
    assert binary.detection_acceptance_profile(df, threshold=0.5, **SCORED).collect()[1]["precision"] == 0.0


def test_curves_of_one_class_days(spark):
    df = scored(spark, [(day(1), 1, 0.3), (day(1), 1, 0.7), (day(2), 0, 0.3), (day(2), 0, 0.8), (day(3), None, 0.5)])
    aucs = [r["auc_roc"] for r in curves.curve_discrimination(df, **SCORED).collect()]
    assert aucs == [1.0, 0.0, 0.5]


def test_auc_of_tied_scores_and_its_symmetry(spark):
    rows = [(day(1), i % 3 == 0, round(math.sin(i) * 4) / 4) for i in range(200)]
    df = scored(spark, [(t, int(y), s) for t, y, s in rows])
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    auc = curves.curve_discrimination(df, **SCORED).first()["auc_roc"]
    assert auc == pytest.approx(expected)
    flipped = curves.curve_discrimination(df.withColumn("score", -F.col("score")), **SCORED).first()["auc_roc"]
    assert auc + flipped == pytest.approx(1.0)
    stretched = curves.curve_discrimination(df.withColumn("score", F.exp("score") * 1e6), **SCORED).first()["auc_roc"]
    assert stretched == pytest.approx(auc)


def test_null_segment_is_a_segment(spark):
    df = spark.createDataFrame([(day(1), 1, 0.9, None), (day(1), 0, 0.1, None), (day(1), 0, 0.9, "a"), (day(1), 1, 0.1, "a")],
                               "ts timestamp, label int, score double, seg string")
    rows = {r["seg"]: r["auc_roc"] for r in curves.curve_discrimination(df, group_by=["seg"], **SCORED).collect()}
    assert rows == {None: 1.0, "a": 0.0}


def test_average_precision_of_a_perfect_ranking(spark):
    df = scored(spark, [(day(1), 1, 0.9), (day(1), 1, 0.8), (day(1), 0, 0.2)])
    row = curves.precision_recall_areas(df, **SCORED).first()
    assert row["auprc"] == pytest.approx(1.0) and row["average_precision"] == pytest.approx(1.0)


def test_log_loss_by_hand(spark):
    rows = [(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.9), (1, 1.0), (0, 0.0)]
    df = scored(spark, [(day(1), y, p) for y, p in rows] + [(day(1), 1, 1.2), (day(1), None, 0.4)])
    row = probability.log_loss(df, ts="ts", label="label", prob="score").first()
    clip = lambda p: min(1 - 1e-15, max(1e-15, p))
    expected = sum(-math.log(clip(p)) if y == 1 else -math.log(1 - clip(p)) for y, p in rows) / 6
    assert row["log_loss"] == pytest.approx(expected) and row["total_predictions"] == 6
    assert row["positive_class_count"] == 3 and row["negative_class_count"] == 3


def test_random_guess_of_one_class_is_unknown(spark):
    df = scored(spark, [(day(1), 1, 0.3)])
    assert probability.random_guess_baseline(df, label="label").first()["random_guess_log_loss"] is None


def test_accuracy_by_hand(spark):
    df = spark.createDataFrame([(day(1), 1, 1), (day(1), 0, 0), (day(1), 1, 0), (day(1), 0, 1), (None, 1, 1)],
                               "ts timestamp, p int, y int")
    row = binary.percentage_accuracy(df, ts="ts", label="y", prediction="p").first()
    assert tuple(row)[1:] == (50.0, 2, 4, 50.0)


def test_subgroup_without_rows_has_rate_zero(spark):
    df = spark.createDataFrame([(day(1), 1, 0.9, "a"), (day(1), 0, 0.2, "a")],
                               "ts timestamp, label int, score double, g string")
    row = binary.subgroup_rate_comparison(df, group="g", group_a="a", group_b="b", threshold=0.5, **SCORED).first()
    assert row["rate_difference"] == 0.5 and row["relative_bad_rate_difference"] == 0.0


def test_psi_of_a_sample_with_itself_is_zero(spark):
    df = spark.range(500).select(F.lit(day(1)).alias("ts"), (F.col("id") % 37).cast("double").alias("v"),
                                 (F.col("id") % 4).cast("string").alias("c"))
    assert drift.psi_against_reference(df, df, ts="ts", feature="v").first()[1] == pytest.approx(0.0)
    assert drift.psi_categorical(df, df, ts="ts", feature="c").first()[1] == pytest.approx(0.0)
    constant = df.withColumn("v", F.lit(3.0))
    assert drift.psi_against_reference(constant, constant, ts="ts", feature="v").first()[1] == pytest.approx(0.0)


def test_drift_charges_unseen_bins_to_the_first_bucket(spark):
    rows = [(day(1), float(v)) for v in range(10)] + [(day(5), 0.0), (day(6), 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    out = drift.drift_score(df, ts="ts", feature="v", reference_start=day(1), reference_end=day(2), num_bins=10).collect()
    present = (1.0 - 0.1) * math.log(1.0 / 0.1)
    unseen = 9 * (1e-6 - 0.1) * math.log(1e-6 / 0.1)
    assert out[0]["drift_score"] == pytest.approx(present + unseen)
    assert out[1]["drift_score"] == pytest.approx(present)


def test_trailing_psi_counts_bins_absent_today(spark):
    rows = [(day(1), "a"), (day(1), "b"), (day(2), "a")]
    df = spark.createDataFrame(rows, "ts timestamp, c string")
    out = drift.psi_trailing(df, ts="ts", feature="c", bucket="1 day", categorical=True).collect()
    assert out[0][1] == pytest.approx(2 * (0.5 - 1e-6) * math.log(0.5 / 1e-6))
    assert out[1][1] == pytest.approx((1.0 - 0.5) * math.log(1.0 / 0.5))


def test_core_accuracy_by_hand(spark):
    cases = [(95, 100), (110, 100), (90, 100), (89, 100), (111, 100), (48000, 50000), (52000, 50000)]
    df = pairs(spark, [*cases, (1, 0), (1, 0.00005)])
    row = regression.core_accuracy(df, threshold=0.10, **PAIR).first()
    assert row["accurate_predictions_count"] == 5 and row["total_predictions_count"] == 7


def test_extreme_valuation_keeps_tiny_actuals_in_the_total(spark):
    df = pairs(spark, [(150, 100), (70, 100), (100, 100), (1, 0.00005), (5, 0)])
    over = regression.extreme_valuation(df, direction="over", **PAIR).first()
    under = regression.extreme_valuation(df, direction="under", **PAIR).first()
    assert over["extreme_overvaluation_count"] == 1 and over["total_predictions"] == 4
    assert under["extreme_undervaluation_count"] == 1 and under["extreme_undervaluation_rate"] == 0.25


def test_end_of_term_gives_a_row_per_inference(spark):
    df = spark.createDataFrame(
        [(day(31, 5), 3.0, 1.0), (day(31, 9), 1.0, 1.0), (day(30), 9.0, 1.0)],
        "ts timestamp, prediction double, actual double")
    for term, n in (("month", 2), ("quarter", 0), ("year", 0), ("decade", 0)):
        assert regression.end_of_term_error(df, term_boundary=term, **PAIR).count() == n


def test_percentage_errors_skip_zero_actuals(spark):
    row = regression.percentage_errors(pairs(spark, [(110, 100), (80, 100), (130, 100), (5, 0)]), **PAIR).first()
    assert row["mape"] == pytest.approx(20.0) and row["mdape"] == pytest.approx(20.0)
    assert row["deviation_ratio"] == pytest.approx((0.1 - 0.2 + 0.3) / 3)


def test_error_profile_keeps_zero_actuals_without_percentage(spark):
    row = regression.error_profile(pairs(spark, [(5, 0)]), **PAIR).first()
    assert row["absolute_error"] == 5 and row["absolute_percentage_error"] is None


def labelled(spark, rows):
    return spark.createDataFrame([(day(1), str(i), p, g) for i, (p, g) in enumerate(rows)],
                                 "ts timestamp, id string, p array<string>, g array<string>")


BOTH = dict(ts="ts", predicted="p", actual="g")


@pytest.mark.parametrize("p, g, expected", [
    (["cat", "dog", "bird"], ["cat", "dog", "bird"], 1.0),
    (["cat", "dog", "fish"], ["cat", "dog", "bird"], 0.5),
    (["cat", "dog", "bird", "fish"], ["cat", "dog", "bird"], 0.75),
    (["cat", "dog"], ["cat", "dog", "bird"], 2 / 3),
    (["cat", "dog"], ["bird", "fish"], 0.0),
    ([], None, 1.0),
])
def test_jaccard_by_hand(spark, p, g, expected):
    assert multilabel.jaccard_similarity(labelled(spark, [(p, g)]), **BOTH).first()[1] == pytest.approx(expected)


def test_label_confusion_edges(spark):
    df = labelled(spark, [(["a", "a", "", None], ["a", "b"]), (None, ["b"]), ([], []), (["c"], None)])
    rows = {r["series"]: tuple(r)[2:] for r in multilabel.confusion_per_label(df, **BOTH).collect()}
    assert rows == {"a": (1.0, 0.0, 0.0), "b": (0.0, 0.0, 2.0), "c": (0.0, 1.0, 0.0)}
    assert multilabel.exact_match_ratio(df, **BOTH).first()[1] == 0.25


def test_density_by_hand(spark):
    df = labelled(spark, [(["a", "b"], []), (["c", "d"], [])])
    assert multilabel.label_density(df, ts="ts", labels="p").first()[1] == pytest.approx(0.5)


def test_cooccurrence_counts_an_inference_once(spark):
    df = labelled(spark, [(["b", "a"], ["a", "c"]), (["a", "b"], [])]).withColumn("id", F.lit("same"))
    rows = {(r[1], r[2]): (r[3], r[4]) for r in multilabel.label_cooccurrence(df, row_id="id", **BOTH).collect()}
    assert rows == {("a", "b"): (1.0, 0.0), ("a", "c"): (0.0, 1.0)}


def test_completeness_and_null_rates(spark):
    df = spark.createDataFrame([(day(1), 1, "x"), (day(1), None, "y"), (day(1), 2, None), (None, None, None)],
                               "ts timestamp, a int, b string")
    row = quality.completeness(df, ts="ts", required=["a", "b"]).first()
    assert row["completeness_pct"] == pytest.approx(100 / 3) and row["incomplete_row_count"] == 2
    rates = {r["series"]: r["null_rate_pct"] for r in quality.null_rates(df, ts="ts", columns=["a", "b"]).collect()}
    assert rates == pytest.approx({"a": 100 / 3, "b": 100 / 3})


def test_points_to_double_odds_fits_one_class_score_ranges(spark):
    # Low scores are all 0 and high ones all 1; only the middle is mixed.
    data = [(i / 100, int(i >= 70 or (30 <= i and i % 3 == 0))) for i in range(100)]
    b0 = b1 = 0.0
    for _ in range(50):
        p = [1 / (1 + math.exp(-(b0 + b1 * s))) for s, _ in data]
        g0, g1 = sum(y - q for (_, y), q in zip(data, p)), sum((y - q) * s for (s, y), q in zip(data, p))
        h00, h01, h11 = (sum(q * (1 - q) * s ** k for (s, _), q in zip(data, p)) for k in (0, 1, 2))
        det = h00 * h11 - h01 * h01
        b0, b1 = b0 + (h11 * g0 - h01 * g1) / det, b1 + (h00 * g1 - h01 * g0) / det
    rows = [("mixed", s, y) for s, y in data] + [("split", s, int(s > 0.5)) for s, _ in data]
    rows += [("one class", 0.3, 1), ("one class", 0.4, 1), ("constant", 0.5, 0), ("constant", 0.5, 1), ("mixed", None, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {r["g"]: r for r in operational.points_to_double_odds(df, score="score", label="label", group_by=["g"]).collect()}
    assert got["mixed"]["converged"] and got["mixed"]["log_odds_slope"] == pytest.approx(b1)
    assert got["mixed"]["points_to_double_odds"] == pytest.approx(math.log(2) / b1)
    for g in ("split", "one class", "constant"):
        assert not got[g]["converged"] and got[g]["log_odds_slope"] is None


def test_odds_fit_reads_its_input_once_and_a_hot_group(spark, tmp_path):
    """Nine tenths of the rows in one group, few distinct scores: steps run on counts, each group has its own fit."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (1e6 + F.pmod(F.xxhash64("id"), F.lit(40)) / 10).alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(45)) < F.pmod(F.xxhash64("id"), F.lit(40)) + 3).cast("int").alias("label"))
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counted = spark.read.parquet(path).mapInArrow(seen, "g string, score double, label int")
    got = {r.g: r for r in operational.points_to_double_odds(counted, score="score", label="label", group_by=["g"]).collect()}
    assert reads.value == 20_000 and len(got) == 8 and all(r.converged for r in got.values())
    for g in ("hot", "g0"):
        x, y = np.array([(r.score - 1e6, r.label) for r in rows.filter(F.col("g") == g).collect()]).T
        b = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
            d = np.stack([np.ones_like(x), x])
            b = b + np.linalg.solve((d * (p * (1 - p))) @ d.T, d @ (y - p))
        assert got[g].log_odds_slope == pytest.approx(b[1], rel=1e-6)


def test_pairs_and_coverage_shuffle_one_row_per_inference(spark):
    """Fifty labels a row: what leaves the tasks before the inferences meet is one row for each, then sums."""
    rng = random.Random(3)
    names = [f"l{i}" for i in range(50)]
    rows = []
    for i in range(60):
        for _ in range(rng.choice([1, 1, 2])):
            rows.append((day(1 + i % 2), i if i % 9 else None, rng.sample(names, 50 if i < 5 else rng.randrange(6)) + [None, ""], rng.sample(names, rng.randrange(4))))
    df = spark.createDataFrame(rows, "ts timestamp, id long, p array<string>, a array<string>").repartition(3)
    pairs, with_pair = {}, {}
    ids = {}
    for ts, i, p, a in rows:
        ids.setdefault(ts, set()).update({i} - {None})
        for name, labels in (("p", p), ("a", a)):
            real = sorted({x for x in labels if x})
            for x in range(len(real)):
                if name == "p" and i is not None:
                    with_pair.setdefault((ts, real[x]), set()).add(i)
                for y in range(x + 1, len(real)):
                    pairs.setdefault((ts, real[x], real[y]), {"p": set(), "a": set()})[name].add(i)
    out = multilabel.label_cooccurrence(df, ts="ts", row_id="id", predicted="p", actual="a")
    assert {(r.ts, r.label_1, r.label_2): (r.pred_cooccurrence_count, r.gt_cooccurrence_count) for r in out.collect()} == {
        k: (len(v["p"]), len(v["a"])) for k, v in pairs.items()}
    cover = multilabel.coverage_ratio(df, ts="ts", row_id="id", labels="p")
    assert {(r.ts, r.series): pytest.approx(r.coverage_ratio) for r in cover.collect() if r.coverage_ratio} == {
        k: len(v) / len(ids[k[0]]) for k, v in with_pair.items()}
    for frame, unfolded in ((out, "label_1"), (cover, "series")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert any("_id#" in line for line in exchanges) and not any("_id#" in line and unfolded in line for line in exchanges)
