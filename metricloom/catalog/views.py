"""Inference tables derived from the test tables, in Spark and in SQL with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The order priorities of the test data, used as class names.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.least(F.col("value") / 200.0, F.lit(1.0))
    return events(spark, sf_dir).select(
        "ts", F.col("event_id").alias("row_id"), score.alias("score"),
        F.col("event_type").isin("error", "signup").cast("int").alias("label"),
        (score >= 0.5).cast("int").alias("pred"),
        F.col("event_type").alias("segment"),
        (F.col("user_id") % 2).cast("string").alias("grp"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (price / 1.05).alias("prediction"), (price * (1 - F.col("l_discount")) / 1.01).alias("actual"),
        F.col("l_returnflag").alias("segment"),
    )


def _sorted_distinct(labels: str):
    """Distinct elements in ascending order, NULL last; native functions, as ``array_sort`` compares in a lambda."""
    null = F.array(F.lit(None).cast("string"))
    return F.concat(F.sort_array(F.array_except(labels, null)), F.array_intersect(F.col(labels), null))


def multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their labels; an order without line items has NULL arrays."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.concat(F.lit("L"), F.col("l_partkey") % 6).alias("p"),
        F.concat(F.lit("L"), F.col("l_suppkey") % 6).alias("g"),
        (F.col("l_discount") * 10).alias("c"),
    )
    # Nearly every order is new to a map task: shuffled first, its items are sorted once and not on both sides of the shuffle.
    lists = items.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("p", "g", "c")).alias("i"))
    pred = _sorted_distinct("i.p")
    best = F.transform(
        pred, lambda p: F.array_max(F.transform(F.filter("i", lambda x: x["p"] == p), lambda x: x["c"]))
    )
    lists = lists.select(
        "l_orderkey", pred.alias("pred"), _sorted_distinct("i.g").alias("gt"), best.alias("confidence")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("segment"),
    )
    return orders.join(lists, F.col("row_id") == F.col("l_orderkey"), "left").drop("l_orderkey")


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    probs = [
        (((F.col("o_orderkey") + 13 * i) % 97 + 1) / 100.0).alias(f"prob_{i}") for i in range(len(PRIORITIES))
    ]
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("truth"),
        F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int")).alias("prediction"), *probs,
    )


def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster")
    )
    return events(spark, sf_dir).select("ts", "event_id").join(
        vectors, F.col("event_id") == F.col("vec_id")
    ).select("ts", F.col("vec_id").alias("row_id"), "cluster", "features",
             *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    times = events(spark, sf_dir).select("ts", F.col("event_id").alias("doc_id"))
    return docs.join(labels, "doc_id", "left").join(times, "doc_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as already scored model answers."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.length("text").alias("n_chars")
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality", "toxic")
    times = events(spark, sf_dir).select("ts", F.col("event_id").alias("conv_id"))
    n = F.col("n_chars")
    return turns.join(labels, "conv_id", "left").join(times, "conv_id").select(
        "ts", "conv_id", "turn", "role", "quality", "toxic", n.alias("tokens"),
        F.when(F.col("toxic") == 1, "Fail").when(F.col("toxic") == 0, "Pass").otherwise("Skipped").alias("result"),
        F.when(n % 4 == 0, "Fail").otherwise("Pass").alias("rule_result"),
        F.element_at(F.array(*[F.lit(t) for t in ("regex", "pii", "toxicity")]), (n % 3 + 1).cast("int")).alias("rule_type"),
        (n % 100 / 100.0).alias("toxicity_score"), (n % 37 / 37.0).alias("pii_score"),
        (n % 250).cast("double").alias("rule_latency"), (n % 11 / 11.0).alias("hallucination_intensity"),
        (n % 5).alias("claims"), F.least(n % 5, n % 3).alias("valid_claims"),
        (n % 7 == 0).alias("pii_found"), (n % 9 == 0).alias("sensitive_found"), (n % 13 == 0).alias("injection_found"),
        F.when(n % 6 == 0, "wrong").otherwise("right").alias("tool_result"),
        F.when(n % 8 == 0, "unused").otherwise("used").alias("tool_usage"),
        F.when(n % 10 == 0, "poor").otherwise("good").alias("tool_selection"),
        F.when(n % 12 == 0, "irrelevant").otherwise("relevant").alias("query_relevance"),
        F.when(n % 14 == 0, "irrelevant").otherwise("relevant").alias("response_relevance"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as API calls: value is the duration in milliseconds."""
    micros = F.round(F.col("value") * 1000).cast("long")
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("user_id") % 10 == 0, 404)
        .when(F.col("user_id") % 10 == 1, 302)
        .otherwise(200)
    )
    return events(spark, sf_dir).select(
        "ts", F.col("event_id").alias("request_id"), "user_id", "event_type", "value",
        F.col("ts").alias("started"), F.timestamp_micros(F.unix_micros("ts") + micros).alias("finished"),
        status.alias("status"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the treated half of the customers, and the last ship date of each order."""
    closed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("opened"), F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("amount"), (F.col("o_custkey") % 2 == 0).alias("treated"),
        (F.col("o_orderstatus") == "F").alias("settled"),
    )
    return orders.join(closed, F.col("order_id") == F.col("l_orderkey")).select(
        "opened", F.col("closed").cast("timestamp").alias("closed"), "order_id", "amount", "treated", "settled"
    )


_FLAG = "CASE WHEN n % {} = 0 THEN '{}' ELSE '{}' END"

VIEW_SQL: dict[str, str] = {
    "inf_binary": (
        "SELECT ts, event_id AS row_id, least(value / 200.0, 1.0) AS score, "
        "CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS label, "
        "CASE WHEN least(value / 200.0, 1.0) >= 0.5 THEN 1 ELSE 0 END AS pred, event_type AS segment, "
        "CAST(user_id % 2 AS VARCHAR) AS grp, value AS amount, CAST(props ->> '$.k' AS DOUBLE) AS k FROM events"
    ),
    "inf_regression": (
        "SELECT l_shipdate AS ts, l_extendedprice / 1.05 AS prediction, "
        "l_extendedprice * (1 - l_discount) / 1.01 AS actual, l_returnflag AS segment FROM lineitem"
    ),
    "item_labels": (
        "SELECT l_orderkey, 'L' || (l_partkey % 6) AS p, 'L' || (l_suppkey % 6) AS g, l_discount * 10 AS c FROM lineitem"
    ),
    "inf_multilabel": (
        "SELECT o_orderdate AS ts, o_orderkey AS row_id, o_orderstatus AS segment, pred, gt, confidence FROM orders "
        "LEFT JOIN (SELECT l_orderkey, list(p ORDER BY p) AS pred, list(c ORDER BY p) AS confidence FROM "
        "(SELECT l_orderkey, p, max(c) AS c FROM item_labels GROUP BY ALL) GROUP BY 1) a ON a.l_orderkey = o_orderkey "
        "LEFT JOIN (SELECT l_orderkey, list(g ORDER BY g) AS gt FROM "
        "(SELECT DISTINCT l_orderkey, g FROM item_labels) GROUP BY 1) b ON b.l_orderkey = o_orderkey"
    ),
    "inf_multiclass": (
        "SELECT o_orderdate AS ts, o_orderkey AS row_id, o_orderpriority AS truth, "
        "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][o_custkey % 5 + 1] AS prediction, "
        + ", ".join(f"((o_orderkey + {13 * i}) % 97 + 1) / 100.0 AS prob_{i}" for i in range(5))
        + " FROM orders"
    ),
    "inf_cluster": (
        "SELECT ts, vec_id AS row_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS features "
        "FROM embeddings JOIN events ON event_id = vec_id"
    ),
    "inf_documents": (
        "SELECT ts, d.doc_id, lang, source, n_chars, quality, toxic FROM documents d "
        "LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN events ON event_id = d.doc_id"
    ),
    "turns": (
        "SELECT ts, c.conv_id, turn, role, quality, toxic, length(text) AS n FROM conversations c "
        "LEFT JOIN labels l ON l.doc_id = c.conv_id JOIN events ON event_id = c.conv_id"
    ),
    "inf_responses": (
        "SELECT ts, conv_id, turn, role, quality, toxic, n AS tokens, "
        "CASE toxic WHEN 1 THEN 'Fail' WHEN 0 THEN 'Pass' ELSE 'Skipped' END AS result, "
        f"{_FLAG.format(4, 'Fail', 'Pass')} AS rule_result, ['regex', 'pii', 'toxicity'][n % 3 + 1] AS rule_type, "
        "n % 100 / 100.0 AS toxicity_score, n % 37 / 37.0 AS pii_score, CAST(n % 250 AS DOUBLE) AS rule_latency, "
        "n % 11 / 11.0 AS hallucination_intensity, n % 5 AS claims, least(n % 5, n % 3) AS valid_claims, "
        "n % 7 = 0 AS pii_found, n % 9 = 0 AS sensitive_found, n % 13 = 0 AS injection_found, "
        f"{_FLAG.format(6, 'wrong', 'right')} AS tool_result, {_FLAG.format(8, 'unused', 'used')} AS tool_usage, "
        f"{_FLAG.format(10, 'poor', 'good')} AS tool_selection, "
        f"{_FLAG.format(12, 'irrelevant', 'relevant')} AS query_relevance, "
        f"{_FLAG.format(14, 'irrelevant', 'relevant')} AS response_relevance FROM turns"
    ),
    "inf_requests": (
        "SELECT ts, event_id AS request_id, user_id, event_type, value, ts AS started, "
        "ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) AS finished, "
        "CASE WHEN event_type = 'error' THEN 500 WHEN user_id % 10 = 0 THEN 404 WHEN user_id % 10 = 1 THEN 302 "
        "ELSE 200 END AS status FROM events"
    ),
    "inf_sales": (
        "SELECT o_orderdate AS opened, closed, o_orderkey AS order_id, o_totalprice AS amount, "
        "o_custkey % 2 = 0 AS treated, o_orderstatus = 'F' AS settled FROM orders "
        "JOIN (SELECT l_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
    ),
}
