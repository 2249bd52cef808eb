"""Registered queries: default aggregations, scored text and agents, operational formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import views
from metricloom.catalog.registry import register
from metricloom.functions import sketches
from metricloom.operators import defaults as D
from metricloom.operators import operational as O

FIVE = "time_bucket(INTERVAL '5 minutes', ts) AS bucket"


@register("inference_count", "D1 O8 A1 F1 G1", "bucket:t segment:s inference_count:i",
          f"SELECT {FIVE}, segment, count(*) AS inference_count FROM inf_binary GROUP BY ALL")
def _(spark, d):
    return D.inference_count(views.binary(spark, d), ts="ts", segments=["segment"])


@register("null_count", "D2", "bucket:t null_count:i",
          f"SELECT {FIVE}, count(*) FILTER (quality IS NULL) AS null_count FROM inf_documents GROUP BY 1")
def _(spark, d):
    return D.null_count(views.documents(spark, d), ts="ts", column="quality")


@register("category_count", "D3", "bucket:t category:s category_count:i",
          f"SELECT {FIVE}, lang AS category, count(*) AS category_count FROM inf_documents GROUP BY ALL")
def _(spark, d):
    return D.category_count(views.documents(spark, d), ts="ts", column="lang")


@register("numeric_distribution", "D4 A2 A3", "bucket:t n:i min_value:6 max_value:6 avg_value:6 stddev_value:6",
          f"SELECT {FIVE}, count(amount) AS n, min(amount) AS min_value, max(amount) AS max_value, "
          "avg(amount) AS avg_value, stddev_samp(amount) AS stddev_value FROM inf_binary GROUP BY 1")
def _(spark, d):
    return D.numeric_distribution(views.binary(spark, d), ts="ts", column="amount")


@register("numeric_distribution_sketch", "D4 K1 K4 K5", "bucket:t n:i sketch_n:i sketch_min:6 sketch_max:6",
          "SELECT date_trunc('day', ts) AS bucket, count(amount) AS n, count(amount) AS sketch_n, "
          "min(amount) AS sketch_min, max(amount) AS sketch_max FROM inf_binary GROUP BY 1")
def _(spark, d):
    out = D.numeric_distribution(views.binary(spark, d), ts="ts", column="amount", bucket="1 day", with_sketch=True)
    return out.select("bucket", "n", sketches.count("sketch").alias("sketch_n"),
                      sketches.min_item("sketch").alias("sketch_min"), sketches.max_item("sketch").alias("sketch_max"))


@register("numeric_sum", "D5 A2", "bucket:t segment:s numeric_sum:4",
          f"SELECT {FIVE}, segment, sum(amount) AS numeric_sum FROM inf_binary GROUP BY ALL")
def _(spark, d):
    return D.numeric_sum(views.binary(spark, d), ts="ts", column="amount", segments=["segment"])


@register("count_by_class", "D9", "bucket:t label:s class_count:i",
          f"SELECT {FIVE}, label, count(*) AS class_count FROM inf_binary GROUP BY ALL")
def _(spark, d):
    return D.count_by_class(views.binary(spark, d), ts="ts", label="label")


@register("count_by_threshold", "D10 F5", "bucket:t label:s class_count:i",
          f"SELECT {FIVE}, CASE WHEN score >= 0.9 THEN 'FRAUD' ELSE 'NOT_FRAUD' END AS label, "
          "count(*) AS class_count FROM inf_binary GROUP BY ALL")
def _(spark, d):
    return D.count_by_threshold(views.binary(spark, d), ts="ts", score="score", threshold=0.9, true_label="FRAUD",
                                false_label="NOT_FRAUD")


@register("multiclass_count_by_class", "D13", "bucket:t label:s class_count:i",
          f"SELECT {FIVE}, prediction AS label, count(*) AS class_count FROM inf_multiclass GROUP BY ALL")
def _(spark, d):
    return D.count_by_class(views.multiclass(spark, d), ts="ts", label="prediction")


# --- Scored text and agents: one query per reported count ---

RESULT_COUNTS = {
    "pass_fail_count": ("D16", ("result",)),
    "rule_result_count": ("D16", ("rule_type", "rule_result")),
    "tool_result_count": ("D18", ("tool_result",)),
    "tool_usage_eval_count": ("D18", ("tool_usage",)),
    "tool_selection_eval_count": ("D18", ("tool_selection",)),
    "query_relevance_eval_count": ("D18", ("query_relevance",)),
    "response_relevance_eval_count": ("D18", ("response_relevance",)),
}
for _name, (_ids, _keys) in RESULT_COUNTS.items():
    @register(_name, _ids, "bucket:t " + " ".join(f"{k}:s" for k in _keys) + " n:i",
              f"SELECT {FIVE}, {', '.join(_keys)}, count(*) AS n FROM inf_responses GROUP BY ALL")
    def _(spark, d, keys=_keys):
        return D.result_count(views.responses(spark, d), ts="ts", results=list(keys), name="n")

FLAG_COUNTS = {
    "hallucination_count": "quality = 0",
    "toxicity_count": "toxic = 1",
    "pii_count": "pii_found",
    "sensitive_data_count": "sensitive_found",
    "prompt_injection_count": "injection_found",
}
for _name, _condition in FLAG_COUNTS.items():
    @register(_name, "D16 A5", f"bucket:t role:s {_name}:i",
              f"SELECT {FIVE}, role, count(*) FILTER ({_condition}) AS {_name} FROM inf_responses GROUP BY ALL")
    def _(spark, d, name=_name, condition=_condition):
        return D.flagged_count(views.responses(spark, d), ts="ts", condition=F.expr(condition), name=name,
                               segments=["role"])

CLAIM_SUMS = {"claim_count": "claims", "valid_claim_count": "valid_claims", "invalid_claim_count": "claims - valid_claims"}
for _name, _value in CLAIM_SUMS.items():
    @register(_name, "D16", "bucket:t numeric_sum:i",
              f"SELECT {FIVE}, sum({_value}) AS numeric_sum FROM inf_responses GROUP BY 1")
    def _(spark, d, value=_value):
        rows = views.responses(spark, d).withColumn("_value", F.expr(value))
        return D.numeric_sum(rows, ts="ts", column="_value")


@register("token_count", "D16 O9", "bucket:t role:s token_count:i",
          f"SELECT {FIVE}, role, sum(tokens) AS token_count FROM inf_responses GROUP BY ALL")
def _(spark, d):
    return D.token_count(views.responses(spark, d), ts="ts", tokens="tokens", segments=["role"])


@register("trace_count", "D18 A6", "bucket:t trace_count:i",
          "SELECT date_trunc('hour', ts) AS bucket, count(DISTINCT conv_id) AS trace_count FROM inf_responses GROUP BY 1")
def _(spark, d):
    return D.trace_count(views.responses(spark, d), ts="ts", trace_id="conv_id", bucket="1 hour")


for _score in ("toxicity_score", "pii_score", "rule_latency", "hallucination_intensity"):
    @register(f"{_score}_distribution", "D17 K1 K2", "bucket:t rule_type:s n:i min_value:6 max_value:6",
              f"SELECT date_trunc('day', ts) AS bucket, rule_type, count({_score}) AS n, min({_score}) AS min_value, "
              f"max({_score}) AS max_value FROM inf_responses GROUP BY ALL")
    def _(spark, d, score=_score):
        fine = D.score_sketch(views.responses(spark, d), ts="ts", score=score, segments=["rule_type"])
        merged = fine.groupBy(F.date_trunc("day", "bucket").alias("bucket"), "rule_type").agg(
            sketches.merge("value").alias("value"))
        return merged.select("bucket", "rule_type", sketches.count("value").alias("n"),
                             sketches.min_item("value").alias("min_value"), sketches.max_item("value").alias("max_value"))


# --- Operational formulas ---


@register("average_daily_rate", "O1", "event_type:s average_daily_rate:6",
          "SELECT event_type, count(*) / (date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1) "
          "AS average_daily_rate FROM inf_requests GROUP BY 1")
def _(spark, d):
    return O.average_daily_rate(views.requests(spark, d), ts="ts", group_by=["event_type"])


def day_of(spark, d):
    return views.requests(spark, d).withColumn("day", F.to_date("ts"))


@register("click_through_rate", "O2", "day:d click_through_rate:6",
          "SELECT CAST(ts AS DATE) AS day, sum(CAST(event_type = 'click' AS INT)) / sum(CAST(event_type = 'view' AS INT)) "
          "AS click_through_rate FROM inf_requests GROUP BY 1")
def _(spark, d):
    return O.event_ratio(day_of(spark, d), numerator=F.col("event_type") == "click",
                         denominator=F.col("event_type") == "view", name="click_through_rate", keys=["day"])


@register("contact_rate", "O3 A6", "day:d contact_rate:6",
          "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) FILTER (event_type = 'error') / count(DISTINCT user_id) "
          "AS contact_rate FROM inf_requests GROUP BY 1")
def _(spark, d):
    return O.distinct_ratio(day_of(spark, d), condition=F.col("event_type") == "error", subject="user_id",
                            name="contact_rate", keys=["day"])


@register("days_to_closing", "O4", "settled:b days_to_closing:6",
          "SELECT settled, avg(date_diff('day', CAST(opened AS DATE), CAST(closed AS DATE))) AS days_to_closing "
          "FROM inf_sales GROUP BY 1")
def _(spark, d):
    return O.days_to_closing(views.sales(spark, d), opened="opened", closed="closed", group_by=["settled"])


LIFTS = {
    "lift_average_daily_balance": ("avg", "amount"),
    "lift_revenue": ("sum", "amount"),
    "lift_settled_sales": ("sum", "CASE WHEN settled THEN 1.0 ELSE 0.0 END"),
}
for _name, (_how, _value) in LIFTS.items():
    @register(_name, "O5", f"year:t {_name}:6",
              f"SELECT year, (t - c) / nullif(c, 0) * 100 AS {_name} FROM (SELECT date_trunc('year', opened) AS year, "
              f"{_how}({_value}) FILTER (treated) AS t, {_how}({_value}) FILTER (NOT treated) AS c FROM inf_sales GROUP BY 1)")
    def _(spark, d, name=_name, how=_how, value=_value):
        return O.lift(views.sales(spark, d), value=F.expr(value), treated=F.col("treated"), name=name, how=how,
                      keys=[F.date_trunc("year", "opened").alias("year")])


NEWTON_STEPS = 10
# Newton steps of the logistic fit, unrolled: each one sums over all rows.
LOGISTIC_SQL = """
WITH start AS MATERIALIZED (SELECT avg(score) AS mean, stddev_pop(score) AS sd, ln(sum(label) / sum(1 - label)) AS b0 FROM inf_binary),
z AS MATERIALIZED (SELECT (score - mean) / sd AS z, label AS y, sd FROM inf_binary, start),
s0 AS MATERIALIZED (SELECT b0, 0.0::DOUBLE AS b1, NULL::DOUBLE AS move FROM start)""" + "".join(f""",
s{i} AS MATERIALIZED (SELECT b0 + d0 AS b0, b1 + d1 AS b1, greatest(abs(d0), abs(d1)) AS move FROM (
  SELECT b0, b1, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS d0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS d1 FROM (
    SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(y - p) AS g0, sum((y - p) * z) AS g1, sum(p * (1 - p)) AS h00,
      sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) AS h11
    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM z, s{i - 1}))))""" for i in range(1, NEWTON_STEPS + 1)) + f"""
SELECT slope AS log_odds_slope, ln(2) / slope AS points_to_double_odds, converged FROM (
  SELECT coalesce(move < 1e-8, false) AS converged, CASE WHEN move < 1e-8 THEN b1 / (SELECT sd FROM start) END AS slope
  FROM s{NEWTON_STEPS})"""


@register("points_to_double_odds", "O6", "log_odds_slope:6 points_to_double_odds:5 converged:b", LOGISTIC_SQL)
def _(spark, d):
    return O.points_to_double_odds(views.binary(spark, d), score="score", label="label", steps=NEWTON_STEPS)


@register("score_utilisation", "O7", "day:d score_utilisation_pct:6",
          "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase' AND status = 200) / "
          "count(*) FILTER (event_type = 'purchase') * 100 AS score_utilisation_pct FROM inf_requests GROUP BY 1")
def _(spark, d):
    eligible = F.col("event_type") == "purchase"
    return O.event_ratio(day_of(spark, d), numerator=eligible & (F.col("status") == 200), denominator=eligible,
                         name="score_utilisation_pct", scale=100.0, keys=["day"])


@register("request_volume", "O8 A1", "bucket:t event_type:s volume:i",
          "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS volume FROM inf_requests GROUP BY ALL")
def _(spark, d):
    return O.volume(views.requests(spark, d), ts="ts", bucket="1 hour", group_by=["event_type"])


@register("token_cost", "O9", "bucket:t cost:6",
          "SELECT date_trunc('day', ts) AS bucket, sum(tokens) * 0.0003 AS cost FROM inf_responses GROUP BY 1")
def _(spark, d):
    return O.cost(views.responses(spark, d), ts="ts", units=F.col("tokens"), rate=0.0003)


@register("compute_cost", "O9", "bucket:t cost:6",
          "SELECT date_trunc('day', ts) AS bucket, sum(value / 1000) * 0.07 AS cost FROM inf_requests GROUP BY 1")
def _(spark, d):
    return O.cost(views.requests(spark, d), ts="ts", units=F.col("value") / 1000, rate=0.07)


@register("request_latency", "O10 X8", "bucket:t event_type:s latency_ms:9",
          "SELECT date_trunc('day', ts) AS bucket, event_type, avg((epoch_us(finished) - epoch_us(started)) / 1000) "
          "AS latency_ms FROM inf_requests GROUP BY ALL")
def _(spark, d):
    return O.latency_ms(views.requests(spark, d), ts="ts", started="started", finished="finished",
                        group_by=["event_type"])


@register("http_errors", "O11 A5",
          "bucket:t failed_calls:i http_errors:i total_calls:i api_error_rate:6 http_error_rate:6", """
SELECT date_trunc('day', ts) AS bucket, count(*) FILTER (status // 100 <> 2) AS failed_calls,
  count(*) FILTER (status >= 400) AS http_errors, count(*) AS total_calls, failed_calls / total_calls * 100 AS api_error_rate,
  http_errors / total_calls * 100 AS http_error_rate FROM inf_requests GROUP BY 1""")
def _(spark, d):
    return O.http_errors(views.requests(spark, d), ts="ts", status="status")
