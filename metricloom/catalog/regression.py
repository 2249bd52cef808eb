"""Registered queries: regression error metrics."""

from __future__ import annotations

from metricloom.catalog import views
from metricloom.catalog.registry import register
from metricloom.operators import regression as R

PAIR = dict(ts="ts", prediction="prediction", actual="actual")
VALUES = dict(prediction="prediction", actual="actual")
ROWS = ("(SELECT *, date_trunc('day', ts) AS day, prediction - actual AS e, "
        "(prediction - actual) / actual AS rel FROM inf_regression)")


def daily(expressions: str, where: str = "true") -> str:
    return f"SELECT day AS ts, {expressions} FROM {ROWS} WHERE {where} GROUP BY 1"


@register("rmse", "R1 X1", "ts:t rmse:4", daily("sqrt(avg(e * e)) AS rmse"))
def _(spark, d):
    return R.rmse(views.regression(spark, d), **PAIR)


@register("rmse_by_segment_month", "R1 U5 X7", "ts:t segment:s rmse:4",
          "SELECT date_trunc('month', ts) AS ts, segment, sqrt(avg(power(prediction - actual, 2))) AS rmse "
          "FROM inf_regression GROUP BY ALL")
def _(spark, d):
    return R.rmse(views.regression(spark, d), bucket="1 month", group_by=["segment"], **PAIR)


@register("cumulative_error", "R2 T9 W2", "ts:t cumulative_error:1",
          f"SELECT ts, sum(net) OVER (ORDER BY ts) AS cumulative_error FROM ({daily('sum(e) AS net')})")
def _(spark, d):
    return R.cumulative_error(views.regression(spark, d), **PAIR)


for _term, _step in (("month", "1 month"), ("quarter", "3 months"), ("year", "1 year")):
    @register(f"end_of_{_term}_error", "R3 X7 X8", "ts:t end_of_term_error:4",
              f"SELECT day AS ts, abs(e) AS end_of_term_error FROM {ROWS} "
              f"WHERE date_trunc('{_term}', day + INTERVAL '1 day') = day + INTERVAL '1 day'")
    def _(spark, d, term=_term):
        return R.end_of_term_error(views.regression(spark, d), term_boundary=term, **PAIR)


@register("absolute_error_rows", "R4", "ts:t absolute_error:4", f"SELECT ts, abs(e) AS absolute_error FROM {ROWS}")
def _(spark, d):
    return R.absolute_error(views.regression(spark, d), **PAIR)


@register("forecast_error_rows", "R5", "ts:t forecast_error:4", f"SELECT ts, e AS forecast_error FROM {ROWS}")
def _(spark, d):
    return R.forecast_error(views.regression(spark, d), **PAIR)


@register("absolute_percentage_error_rows", "R6", "ts:t absolute_percentage_error:6",
          f"SELECT ts, abs(rel) * 100 AS absolute_percentage_error FROM {ROWS}")
def _(spark, d):
    return R.absolute_percentage_error(views.regression(spark, d), **PAIR)


@register("error_profile", "R7", "ts:t absolute_error:4 forecast_error:4 absolute_percentage_error:6",
          f"SELECT day AS ts, abs(e) AS absolute_error, e AS forecast_error, abs(rel) * 100 AS absolute_percentage_error FROM {ROWS}")
def _(spark, d):
    return R.error_profile(views.regression(spark, d), **PAIR)


@register("maximum_errors", "R8", "ts:t max_error:4 max_relative_error:6",
          daily("max(abs(e)) AS max_error, max(abs(rel)) * 100 AS max_relative_error"))
def _(spark, d):
    return R.maximum_errors(views.regression(spark, d), **PAIR)


SPREAD = ("SELECT ts, avg(abs(prediction - m)) AS mad, stddev_samp(prediction) AS std_dev, mad / nullif(std_dev, 0) "
          f"AS mad_to_std_ratio FROM (SELECT day AS ts, prediction, avg(prediction) OVER (PARTITION BY day) AS m FROM {ROWS}) "
          "GROUP BY 1")


@register("mean_absolute_deviation", "R9 W9", "ts:t mad:4", SPREAD)
def _(spark, d):
    return R.mean_absolute_deviation(views.regression(spark, d), ts="ts", prediction="prediction")


@register("mean_absolute_deviation_with_spread", "R10 A3", "ts:t mad:4 std_dev:4 mad_to_std_ratio:6", SPREAD)
def _(spark, d):
    return R.mean_absolute_deviation(views.regression(spark, d), ts="ts", prediction="prediction", with_spread=True)


@register("normalized_mad", "R11", "ts:t normalized_mad:6", daily("avg(abs(e)) / avg(abs(actual)) AS normalized_mad"))
def _(spark, d):
    return R.normalized_mad(views.regression(spark, d), **PAIR)


@register("mape_against_normalized_mad", "R12", "ts:t mape:6 normalized_mad_pct:6 mape_vs_nmad_diff:6",
          daily("avg(abs(rel)) * 100 AS mape, avg(abs(e)) / avg(abs(actual)) * 100 AS normalized_mad_pct, "
                "mape - normalized_mad_pct AS mape_vs_nmad_diff", "actual <> 0"))
def _(spark, d):
    return R.mape_against_normalized_mad(views.regression(spark, d), **PAIR)


@register("percentage_errors", "R13 A8 F3", "ts:t mape:6 mdape:6 deviation_ratio:6",
          daily("avg(abs(rel)) * 100 AS mape, quantile_cont(abs(rel) * 100, 0.5) AS mdape, avg(rel) AS deviation_ratio",
                "actual <> 0"))
def _(spark, d):
    return R.percentage_errors(views.regression(spark, d), **PAIR)


@register("trailing_twelve_months_error", "R14 W7", "ts:t ttm_error:4",
          f"SELECT ts, avg(m) OVER (ORDER BY ts ROWS 364 PRECEDING) AS ttm_error FROM ({daily('avg(abs(e)) AS m')})")
def _(spark, d):
    return R.trailing_twelve_months_error(views.regression(spark, d), **PAIR)


@register("wmape", "R15", "ts:t wmape:6", daily("sum(abs(e)) / sum(abs(actual)) * 100 AS wmape"))
def _(spark, d):
    return R.wmape(views.regression(spark, d), **PAIR)


@register("wmape_by_segment", "R16 L1", "segment:s wmape:6 prediction_count:i total_volume:1 avg_volume:4",
          f"SELECT segment, sum(abs(e)) / sum(abs(actual)) * 100 AS wmape, count(*) AS prediction_count, "
          f"sum(abs(actual)) AS total_volume, avg(abs(actual)) AS avg_volume FROM {ROWS} GROUP BY 1")
def _(spark, d):
    return R.wmape_by_segment(views.regression(spark, d), segment="segment", **VALUES)


ACCURACY = ("avg(CAST(abs(rel) <= 0.03 AS INT)) AS core_accuracy_rate, "
            "count(*) FILTER (abs(rel) <= 0.03) AS accurate_predictions_count, "
            "count(*) AS total_predictions_count, avg(abs(rel)) AS avg_percentage_error")
ACCURACY_OUT = "core_accuracy_rate:6 accurate_predictions_count:i total_predictions_count:i avg_percentage_error:6"


@register("core_accuracy", "R17 F3 A11", f"ts:t {ACCURACY_OUT}", daily(ACCURACY, "abs(actual) > 0.0001"))
def _(spark, d):
    return R.core_accuracy(views.regression(spark, d), threshold=0.03, **PAIR)


@register("core_accuracy_by_segment", "R18 U5", f"ts:t segment:s {ACCURACY_OUT}",
          f"SELECT day AS ts, segment, {ACCURACY} FROM {ROWS} WHERE abs(actual) > 0.0001 GROUP BY ALL")
def _(spark, d):
    return R.core_accuracy(views.regression(spark, d), threshold=0.03, group_by=["segment"], **PAIR)


for _way, _gap, _id in (("over", "e", "R19"), ("under", "-e", "R20")):
    @register(f"extreme_{_way}valuation", _id,
              f"ts:t extreme_{_way}valuation_rate:6 extreme_{_way}valuation_count:i total_predictions:i",
              daily(f"avg(CAST({_gap} / abs(actual) > 0.02 AND abs(actual) > 0.0001 AS INT)) AS extreme_{_way}valuation_rate, "
                    f"count(*) FILTER ({_gap} / abs(actual) > 0.02 AND abs(actual) > 0.0001) AS extreme_{_way}valuation_count, "
                    "count(*) AS total_predictions", "actual <> 0"))
    def _(spark, d, way=_way):
        return R.extreme_valuation(views.regression(spark, d), direction=way, threshold=0.02, **PAIR)


@register("error_bands", "R21 X18 W10", "error_bucket:s n:i percentage:1", f"""
SELECT CASE WHEN a <= 0.05 THEN '0-5% (Excellent)' WHEN a <= 0.1 THEN '5-10% (Good)' WHEN a <= 0.2 THEN '10-20% (Fair)'
  WHEN a <= 0.5 THEN '20-50% (Poor)' ELSE '>50% (Very Poor)' END AS error_bucket, count(*) AS n,
  count(*) / sum(count(*)) OVER () * 100 AS percentage
FROM (SELECT abs(rel) AS a FROM {ROWS} WHERE abs(actual) > 0.0001) GROUP BY 1""")
def _(spark, d):
    return R.error_bands(views.regression(spark, d), **VALUES)


@register("error_percentiles", "R22 A8", "p25_error_pct:6 p50_error_pct:6 p75_error_pct:6 p90_error_pct:6",
          "SELECT " + ", ".join(f"quantile_cont(abs(rel), {p / 100}) * 100 AS p{p}_error_pct" for p in (25, 50, 75, 90))
          + f" FROM {ROWS} WHERE actual <> 0")
def _(spark, d):
    return R.error_percentiles(views.regression(spark, d), **VALUES)


@register("bias_assessment", "R23 A5", "overestimates:i underestimates:i exact_matches:i avg_relative_error:6 bias_assessment:s",
          f"""SELECT count(*) FILTER (e > 0) AS overestimates, count(*) FILTER (e < 0) AS underestimates,
  count(*) FILTER (e = 0) AS exact_matches, avg(rel) AS avg_relative_error,
  CASE WHEN avg(rel) > 0.05 THEN 'Systematic Overestimation' WHEN avg(rel) < -0.05 THEN 'Systematic Underestimation'
  ELSE 'Balanced' END AS bias_assessment FROM {ROWS} WHERE abs(actual) > 0.0001""")
def _(spark, d):
    return R.bias_assessment(views.regression(spark, d), **VALUES)


@register("overvaluation_advice", "R24 A2", "max_overvaluation_pct:6 p95_overvaluation_pct:6 avg_error_pct:6",
          "SELECT max(e / abs(actual)) * 100 AS max_overvaluation_pct, quantile_cont(e / abs(actual), 0.95) * 100 "
          f"AS p95_overvaluation_pct, avg(e / abs(actual)) * 100 AS avg_error_pct FROM {ROWS} WHERE actual <> 0")
def _(spark, d):
    return R.overvaluation_advice(views.regression(spark, d), **VALUES)


@register("undervaluation_advice", "R24 A2", "max_undervaluation_pct:6 p5_undervaluation_pct:6 avg_undervaluation_pct:6",
          "SELECT min(-e / abs(actual)) * 100 AS max_undervaluation_pct, quantile_cont(e / abs(actual), 0.05) * 100 "
          "AS p5_undervaluation_pct, avg(-e / abs(actual)) * 100 AS avg_undervaluation_pct "
          f"FROM {ROWS} WHERE actual <> 0 AND e < 0")
def _(spark, d):
    return R.undervaluation_advice(views.regression(spark, d), **VALUES)


@register("mae_mse", "D11 D12", "ts:t absolute_error_sum:2 squared_error_sum:0 error_count:i mae:4 mse:0",
          daily("sum(abs(e)) AS absolute_error_sum, sum(e * e) AS squared_error_sum, count(*) AS error_count, "
                "avg(abs(e)) AS mae, avg(e * e) AS mse"))
def _(spark, d):
    return R.mae_mse(views.regression(spark, d), **PAIR)
