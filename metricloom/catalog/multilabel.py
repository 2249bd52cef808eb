"""Registered queries: multi-label metrics, clustering, listings over label frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import views
from metricloom.catalog.registry import register
from metricloom.functions.timebuckets import since
from metricloom.operators import clustering, multilabel as M
from metricloom.plans import charts, label_store as L, store as S
from metricloom.session import scratch_path, written

BOTH = dict(ts="ts", predicted="pred", actual="gt")
SETS = ("(SELECT date_trunc('day', ts) AS day, row_id, segment, pred, coalesce(pred, []) AS p, coalesce(gt, []) AS g, "
        "confidence FROM inf_multilabel)")


def confusion(keys: str = "day AS ts") -> str:
    return f"""
SELECT {keys}, label AS series, count(*) FILTER (list_contains(p, label) AND list_contains(g, label)) AS tp,
  count(*) FILTER (list_contains(p, label) AND NOT list_contains(g, label)) AS fp,
  count(*) FILTER (NOT list_contains(p, label) AND list_contains(g, label)) AS fn
FROM (SELECT *, unnest(list_distinct(p || g)) AS label FROM {SETS}) GROUP BY ALL"""


CONFUSION = confusion()
QUALITY = (f"SELECT ts, series, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, "
           f"2 * tp / nullif(2 * tp + fp + fn, 0) AS f1_score FROM ({CONFUSION})")
CLASS_COUNT = f"SELECT day AS ts, label AS series, count(*) AS class_count FROM (SELECT day, unnest(p) AS label FROM {SETS}) GROUP BY ALL"
COVERAGE = (f"SELECT ts, series, class_count / n AS coverage_ratio FROM ({CLASS_COUNT}) JOIN "
            f"(SELECT day, count(DISTINCT row_id) AS n FROM {SETS} GROUP BY 1) ON day = ts")
DENSITY = (f"SELECT day AS ts, avg(len(p)) / (SELECT count(DISTINCT l) FROM (SELECT unnest(p) AS l FROM {SETS})) "
           f"AS label_density FROM {SETS} GROUP BY 1")
EXACT = (f"SELECT day AS ts, avg(CAST(list_sort(list_distinct(p)) = list_sort(list_distinct(g)) AS INT)) "
         f"AS exact_match_ratio FROM {SETS} GROUP BY 1")
JACCARD = (f"SELECT day AS ts, avg(CASE WHEN len(p) + len(g) = 0 THEN 1 ELSE len(list_intersect(p, g)) / "
           f"len(list_distinct(p || g)) END) AS jaccard_similarity FROM {SETS} GROUP BY 1")
CONFIDENCE = (f"SELECT ts, series, s / n AS avg_confidence FROM (SELECT day AS ts, l AS series, sum(c) AS s FROM "
              f"(SELECT day, unnest(p) AS l, unnest(confidence) AS c FROM {SETS}) GROUP BY ALL) JOIN "
              f"(SELECT day, count(*) AS n FROM {SETS} GROUP BY 1) ON day = ts")
PAIRS = f"""
SELECT ts, label_1, label_2, sum(x) AS pred_cooccurrence_count, sum(y) AS gt_cooccurrence_count FROM (
  SELECT day AS ts, a.l AS label_1, b.l AS label_2, 1 AS x, 0 AS y
  FROM {SETS}, unnest(p) AS a(l), unnest(p) AS b(l) WHERE a.l < b.l
  UNION ALL SELECT day, a.l, b.l, 0, 1 FROM {SETS}, unnest(g) AS a(l), unnest(g) AS b(l) WHERE a.l < b.l)
GROUP BY ALL"""


def frame_confusion(spark, d):
    return M.confusion_per_label(views.multilabel(spark, d), **BOTH)


def frame_quality(spark, d):
    return M.precision_recall_f1(views.multilabel(spark, d), **BOTH)


def frame_class_count(spark, d):
    return M.class_count(views.multilabel(spark, d), ts="ts", labels="pred")


def frame_coverage(spark, d):
    return M.coverage_ratio(views.multilabel(spark, d), ts="ts", row_id="row_id", labels="pred")


def frame_density(spark, d):
    return M.label_density(views.multilabel(spark, d), ts="ts", labels="pred")


def frame_volume(spark, d):
    return M.prediction_volume(views.multilabel(spark, d), ts="ts", labels="pred")


def frame_exact(spark, d):
    return M.exact_match_ratio(views.multilabel(spark, d), **BOTH)


def frame_jaccard(spark, d):
    return M.jaccard_similarity(views.multilabel(spark, d), **BOTH)


def frame_confidence(spark, d):
    return M.average_confidence(views.multilabel(spark, d), ts="ts", row_id="row_id", labels="pred",
                                confidences="confidence")


def frame_pairs(spark, d):
    return M.label_cooccurrence(views.multilabel(spark, d), row_id="row_id", **BOTH)


VOLUME = f"SELECT day AS ts, avg(len(p)) AS pred_label_count FROM {SETS} GROUP BY 1"

register("label_confusion", "M1 J4 J12 X10", "ts:t series:s tp:i fp:i fn:i", CONFUSION)(frame_confusion)
register("label_precision_recall_f1", "M2 J2", "ts:t series:s precision:6 recall:6 f1_score:6", QUALITY)(frame_quality)
register("label_class_count", "M3 J12 X10", "ts:t series:s class_count:i", CLASS_COUNT)(frame_class_count)
register("label_coverage_ratio", "M4 A6 J1", "ts:t series:s coverage_ratio:6", COVERAGE)(frame_coverage)
register("label_density", "M5 X13 J5", "ts:t label_density:6", DENSITY)(frame_density)
register("label_prediction_volume", "M6 X13", "ts:t pred_label_count:6", VOLUME)(frame_volume)
register("label_exact_match_ratio", "M7 X14 L9", "ts:t exact_match_ratio:6", EXACT)(frame_exact)
register("label_jaccard_similarity", "M8 L5 L6", "ts:t jaccard_similarity:6", JACCARD)(frame_jaccard)
register("label_average_confidence", "M9 J13 X12 X15", "ts:t series:s avg_confidence:6", CONFIDENCE)(frame_confidence)
register("label_cooccurrence", "M10 J8 J4", "ts:t label_1:s label_2:s pred_cooccurrence_count:i gt_cooccurrence_count:i",
         PAIRS)(frame_pairs)


@register("label_confusion_by_segment_month", "M1 U5", "ts:t segment:s series:s tp:i fp:i fn:i",
          confusion("date_trunc('month', day) AS ts, segment"))
def _(spark, d):
    return M.confusion_per_label(views.multilabel(spark, d), bucket="1 month", group_by=["segment"], **BOTH)


@register("label_pair_association", "M11",
          "ts:t label_1:s label_2:s pair_count:i p_2_given_1:6 p_1_given_2:6 lift:6 jaccard:6", f"""
SELECT k.ts, label_1, label_2, ab AS pair_count, ab / a.n AS p_2_given_1, ab / b.n AS p_1_given_2,
  (ab / r) / ((a.n / r) * (b.n / r)) AS lift, ab / (a.n + b.n - ab) AS jaccard
FROM (SELECT ts, label_1, label_2, sum(pred_cooccurrence_count) AS ab FROM ({PAIRS}) GROUP BY ALL HAVING ab > 0) k
JOIN (SELECT ts, series, class_count AS n FROM ({CLASS_COUNT})) a ON a.ts = k.ts AND a.series = label_1
JOIN (SELECT ts, series, class_count AS n FROM ({CLASS_COUNT})) b ON b.ts = k.ts AND b.series = label_2
JOIN (SELECT day, count(*) AS r FROM {SETS} GROUP BY 1) t ON t.day = k.ts""")
def _(spark, d):
    return M.pair_association(views.multilabel(spark, d), ts="ts", row_id="row_id", labels="pred")


# --- Clustering ---

SILHOUETTE_OUT = "bucket:t series:s cluster_silhouette:6 silhouette_score:6"


def silhouette_sql(distance: str, rows: str = "inf_cluster") -> str:
    return f"""
WITH p AS (SELECT date_trunc('day', ts) AS bucket, row_id, cluster, features FROM {rows}),
m AS (SELECT a.bucket, a.row_id, a.cluster, b.cluster AS other, avg({distance}) AS d
      FROM p a JOIN p b USING (bucket) WHERE a.row_id <> b.row_id GROUP BY ALL),
ab AS (SELECT bucket, row_id, min(d) FILTER (other = cluster) AS a, min(d) FILTER (other <> cluster) AS b FROM m GROUP BY ALL),
s AS (SELECT p.bucket, p.cluster, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0
        ELSE (b - a) / greatest(a, b) END AS s FROM p LEFT JOIN ab USING (bucket, row_id))
SELECT bucket, CAST(cluster AS VARCHAR) AS series, avg(s) AS cluster_silhouette,
  sum(sum(s)) OVER day / sum(count(*)) OVER day AS silhouette_score
FROM s GROUP BY bucket, cluster WINDOW day AS (PARTITION BY bucket)"""


SILHOUETTE = silhouette_sql("list_distance(a.features, b.features)")


def frame_silhouette(spark, d):
    return clustering.silhouette(views.cluster(spark, d), ts="ts", row_id="row_id", cluster="cluster",
                                 features="features")


register("silhouette", "C1 J7 X16", SILHOUETTE_OUT, SILHOUETTE)(frame_silhouette)


@register("silhouette_from_columns", "C2 X16", SILHOUETTE_OUT,
          silhouette_sql("sqrt(" + " + ".join(f"(a.features[{i}] - b.features[{i}]) ** 2" for i in (1, 2, 3)) + ")"))
def _(spark, d):
    return clustering.silhouette(views.cluster(spark, d), ts="ts", row_id="row_id", cluster="cluster",
                                 features=["f0", "f1", "f2"])


@register("silhouette_on_sample", "F10 C1", SILHOUETTE_OUT, silhouette_sql(
    "list_distance(a.features, b.features)",
    "(SELECT * FROM inf_cluster WHERE CAST('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) < 2147483648)"))
def _(spark, d):
    return clustering.silhouette(views.cluster(spark, d), ts="ts", row_id="row_id", cluster="cluster",
                                 features="features", sample=0.5)


# --- Listings and reports over label frames ---

LISTINGS = {
    "class_count_by_label": (frame_class_count, CLASS_COUNT, "class_count:i"),
    "confidence_by_label_over_time": (frame_confidence, CONFIDENCE, "avg_confidence:6"),
    "confusion_matrix_per_label": (frame_confusion, CONFUSION, "tp:i fp:i fn:i"),
    "coverage_ratio_by_label": (frame_coverage, COVERAGE, "coverage_ratio:6"),
    "precision_recall_f1_by_label": (frame_quality, QUALITY, "precision:6 recall:6 f1_score:6"),
    "exact_match_ratio_over_time": (frame_exact, EXACT, "exact_match_ratio:6"),
    "jaccard_similarity_over_time": (frame_jaccard, JACCARD, "jaccard_similarity:6"),
    "label_density_over_time": (frame_density, DENSITY, "label_density:6"),
    "prediction_volume_over_time": (frame_volume, VOLUME, "pred_label_count:6"),
}
for _name, (_frame, _sql, _out) in LISTINGS.items():
    _labelled = "series" in _sql.split("FROM")[0]

    @register(f"chart_{_name}", "V8", ("ts:t label:s " if _labelled else "ts:t ") + _out,
              f"SELECT *{', series AS label' if _labelled else ''} FROM ({_sql})")
    def _(spark, d, frame=_frame, out=_out, labelled=_labelled):
        return charts.listing(frame(spark, d), [c.split(":")[0] for c in out.split()], label=labelled)


DAYS = 30


def recent_sql(sql: str) -> str:
    """The frame's last 30 days, counted back from its own newest day."""
    return f"(SELECT * FROM ({sql}) WHERE ts >= (SELECT max(ts) FROM ({sql})) - INTERVAL '{DAYS} days')"


def recent(frame):
    """The frame's last days; its values are written, so that finding its newest day does not compute them twice."""
    return lambda spark, d: since(written(frame(spark, d), "recent"), "ts", DAYS)


AVERAGES = {
    "confidence_distribution_by_label": (frame_confidence, CONFIDENCE, {"avg_confidence": "avg_confidence"}),
    "coverage_distribution": (frame_coverage, COVERAGE, {"coverage_ratio": "avg_coverage"}),
    "f1_score_comparison": (frame_quality, QUALITY, {"f1_score": "avg_f1_score"}),
    "precision_vs_recall_tradeoff": (frame_quality, QUALITY, {
        "precision": "avg_precision", "recall": "avg_recall", "f1_score": "avg_f1_score"}),
}
for _name, (_frame, _sql, _values) in AVERAGES.items():
    @register(f"chart_{_name}", "V9 F7", "label:s " + " ".join(f"{v}:6" for v in _values.values()),
              f"SELECT series AS label, {', '.join(f'avg({c}) AS {v}' for c, v in _values.items())} "
              f"FROM {recent_sql(_sql)} GROUP BY 1")
    def _(spark, d, frame=_frame, values=_values):
        return charts.label_averages(recent(frame)(spark, d), values)


@register("chart_low_confidence_labels", "V10 A9 L2", "label:s avg_confidence:6 days_measured:i",
          f"SELECT series AS label, avg(avg_confidence) AS avg_confidence, count(*) AS days_measured FROM "
          f"{recent_sql(CONFIDENCE)} GROUP BY 1 HAVING avg(avg_confidence) < 0.5 ORDER BY 2, 1 LIMIT 20")
def _(spark, d):
    return charts.low_confidence_labels(recent(frame_confidence)(spark, d))


@register("chart_confidence_vs_accuracy", "V11 J2", "label:s avg_confidence:6 avg_precision:6",
          f"SELECT series AS label, avg(avg_confidence) AS avg_confidence, avg(precision) AS avg_precision FROM "
          f"{recent_sql(CONFIDENCE)} JOIN ({QUALITY}) USING (ts, series) GROUP BY 1")
def _(spark, d):
    return charts.confidence_against_precision(recent(frame_confidence)(spark, d), frame_quality(spark, d))


@register("chart_exact_match_vs_jaccard", "V12 J4", "ts:t exact_match_ratio:6 jaccard_similarity:6",
          f"SELECT * FROM ({EXACT}) FULL JOIN ({JACCARD}) USING (ts)")
def _(spark, d):
    return charts.exact_match_against_jaccard(frame_exact(spark, d), frame_jaccard(spark, d))


@register("chart_label_error_rates", "V13", "label:s false_positive_rate:6 false_negative_rate:6 total_error_rate:6",
          f"SELECT series AS label, sum(fp) / nullif(sum(tp + fp), 0) AS false_positive_rate, sum(fn) / "
          f"nullif(sum(tp + fn), 0) AS false_negative_rate, sum(fp + fn) / nullif(sum(tp + fp + fn), 0) "
          f"AS total_error_rate FROM {recent_sql(CONFUSION)} GROUP BY 1")
def _(spark, d):
    return charts.label_error_rates(recent(frame_confusion)(spark, d))


@register("chart_tp_fp_fn_comparison", "V14", "label:s total_tp:i total_fp:i total_fn:i",
          f"SELECT series AS label, sum(tp) AS total_tp, sum(fp) AS total_fp, sum(fn) AS total_fn "
          f"FROM {recent_sql(CONFUSION)} GROUP BY 1")
def _(spark, d):
    return charts.label_totals(recent(frame_confusion)(spark, d))


@register("chart_top_labels_by_count", "V15 L2", "label:s total_count:i",
          f"SELECT series AS label, sum(class_count) AS total_count FROM {recent_sql(CLASS_COUNT)} GROUP BY 1 "
          "ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return charts.top_labels(recent(frame_class_count)(spark, d))


PAIR_TOTALS = (f"SELECT label_1, label_2, sum(pred_cooccurrence_count) AS pred_count, sum(gt_cooccurrence_count) "
               f"AS gt_count FROM {recent_sql(PAIRS)} GROUP BY ALL")


@register("chart_top_cooccurring_pairs", "V16 L2", "label_1:s label_2:s pred_count:i gt_count:i",
          f"{PAIR_TOTALS} ORDER BY gt_count DESC, label_1, label_2 LIMIT 20")
def _(spark, d):
    return charts.top_pairs(recent(frame_pairs)(spark, d))


for _which, _name in (("pred", "predicted"), ("gt", "groundtruth")):
    @register(f"chart_{_name}_cooccurrence_heatmap", "V17", "label_1:s label_2:s total_cooccurrence:i",
              f"SELECT label_1, label_2, {_which}_count AS total_cooccurrence FROM ({PAIR_TOTALS})")
    def _(spark, d, which=_which):
        return charts.cooccurrence_heatmap(recent(frame_pairs)(spark, d), which=which)


@register("chart_cooccurrence_comparison", "V18 A9 L2", "label_1:s label_2:s pred_count:i gt_count:i difference:i",
          f"SELECT *, pred_count - gt_count AS difference FROM ({PAIR_TOTALS}) WHERE gt_count > 10 "
          "ORDER BY abs(difference) DESC, label_1, label_2 LIMIT 50")
def _(spark, d):
    return charts.cooccurrence_difference(recent(frame_pairs)(spark, d))


# --- The same listings from a store that is kept day by day: all days once, then the last three again ---

LABEL_COLUMNS = dict(row_id="row_id", predicted="pred", actual="gt", confidences="confidence", model_id="labels")


_stores: dict[tuple[str, str], str] = {}


def label_store(spark, d):
    """One store for all listings over the same tables in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        path = scratch_path(spark, "label-store")
        # Both updates and the five metrics of each read these rows.
        rows = written(views.multilabel(spark, d), "label-rows")
        L.update(rows, path, ts="ts", **LABEL_COLUMNS)
        L.update(rows, path, ts="ts", as_of=rows.agg(F.max("ts")).first()[0], lookback_days=2, **LABEL_COLUMNS)
        _stores[key] = path
    return S.read_store(spark, _stores[key])


def stored(name: str, ids: str, out: str, sql: str):
    """A listing over the store, compared with the listing over raw rows."""
    def add(build):
        register(f"stored_{name}", ids, out, sql)(lambda spark, d: build(label_store(spark, d)))
        return build

    return add


for _name, (_, _sql, _values) in AVERAGES.items():
    def _listing(store, values=_values):
        quality = set(values) & {"precision", "recall", "f1_score"}
        return charts.label_averages(L.quality_frame(store) if quality else L.label_frame(store, list(values)), values)

    stored(_name, "V9 F7 G4", "label:s " + " ".join(f"{v}:6" for v in _values.values()),
           f"SELECT series AS label, {', '.join(f'avg({c}) AS {v}' for c, v in _values.items())} FROM {recent_sql(_sql)} GROUP BY 1")(_listing)

stored("low_confidence_labels", "V10 A9 L2", "label:s avg_confidence:6 days_measured:i",
       f"SELECT series AS label, avg(avg_confidence) AS avg_confidence, count(*) AS days_measured FROM {recent_sql(CONFIDENCE)} "
       "GROUP BY 1 HAVING avg(avg_confidence) < 0.5 ORDER BY 2, 1 LIMIT 20")(
    lambda store: charts.low_confidence_labels(L.label_frame(store, ["avg_confidence"])))
stored("confidence_vs_accuracy", "V11 J2", "label:s avg_confidence:6 avg_precision:6",
       f"SELECT series AS label, avg(avg_confidence) AS avg_confidence, avg(precision) AS avg_precision FROM "
       f"{recent_sql(CONFIDENCE)} JOIN ({QUALITY}) USING (ts, series) GROUP BY 1")(
    lambda store: charts.confidence_against_precision(L.label_frame(store, ["avg_confidence"]), L.quality_frame(store, days=60)))
stored("label_error_rates", "V13", "label:s false_positive_rate:6 false_negative_rate:6 total_error_rate:6",
       f"SELECT series AS label, sum(fp) / nullif(sum(tp + fp), 0) AS false_positive_rate, sum(fn) / nullif(sum(tp + fn), 0) "
       f"AS false_negative_rate, sum(fp + fn) / nullif(sum(tp + fp + fn), 0) AS total_error_rate FROM {recent_sql(CONFUSION)} GROUP BY 1")(
    lambda store: charts.label_error_rates(L.label_frame(store, ["tp", "fp", "fn"])))
stored("tp_fp_fn_comparison", "V14", "label:s total_tp:i total_fp:i total_fn:i",
       f"SELECT series AS label, sum(tp) AS total_tp, sum(fp) AS total_fp, sum(fn) AS total_fn FROM {recent_sql(CONFUSION)} GROUP BY 1")(
    lambda store: charts.label_totals(L.label_frame(store, ["tp", "fp", "fn"])))
stored("top_labels_by_count", "V15 L2", "label:s total_count:i",
       f"SELECT series AS label, sum(class_count) AS total_count FROM {recent_sql(CLASS_COUNT)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda store: charts.top_labels(L.label_frame(store, ["class_count"])))


def stored_pairs(store):
    return L.label_frame(store, ["pred_cooccurrence_count", "gt_cooccurrence_count"], dimensions=L.PAIR)


stored("top_cooccurring_pairs", "V16 L2", "label_1:s label_2:s pred_count:i gt_count:i",
       f"{PAIR_TOTALS} ORDER BY gt_count DESC, label_1, label_2 LIMIT 20")(lambda store: charts.top_pairs(stored_pairs(store)))
for _which, _name in (("pred", "predicted"), ("gt", "groundtruth")):
    stored(f"{_name}_cooccurrence_heatmap", "V17", "label_1:s label_2:s total_cooccurrence:i",
           f"SELECT label_1, label_2, {_which}_count AS total_cooccurrence FROM ({PAIR_TOTALS})")(
        lambda store, which=_which: charts.cooccurrence_heatmap(stored_pairs(store), which=which))
stored("cooccurrence_comparison", "V18 A9 L2", "label_1:s label_2:s pred_count:i gt_count:i difference:i",
       f"SELECT *, pred_count - gt_count AS difference FROM ({PAIR_TOTALS}) WHERE gt_count > 10 "
       "ORDER BY abs(difference) DESC, label_1, label_2 LIMIT 50")(lambda store: charts.cooccurrence_difference(stored_pairs(store)))
