"""Rows that several steps of a query read are computed once."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metricloom.catalog import all_queries, multilabel as catalog, plumbing
from metricloom.functions import labels
from metricloom.operators import multilabel as M
from tests.conftest import day


@pytest.fixture
def orders(spark, tmp_path):
    """Three orders: one with null keys and equal labels, one plain, one without items."""
    rows = [(1, 6, 7, 0.1), (1, 12, 8, 0.3), (1, None, 7, 0.2), (2, 1, 1, 0.5), (2, 2, None, None), (None, 1, 1, 0.9)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, datetime(2001, 1, k), "O") for k in (1, 2, 3)], "o_orderkey long, o_orderdate timestamp, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def reads_raw(df):
    return any("lineitem" in f or "orders" in f for f in df.inputFiles())


def test_labels_of_orders(spark, orders):
    rows = {r.row_id: r for r in catalog.views.multilabel(spark, orders).collect()}
    assert rows[1].pred == ["L0", None] and rows[1].confidence == [3.0, None] and rows[1].gt == ["L1", "L2"]
    assert rows[2].pred == ["L1", "L2"] and rows[2].confidence == [5.0, None] and rows[2].gt == ["L1", None]
    assert rows[3].pred is None and rows[3].gt is None and rows[3].confidence is None


def test_label_store_reads_raw_rows_once(spark, orders, monkeypatch):
    given = []
    monkeypatch.setattr(catalog.L, "update", lambda rows, *a, **k: given.append(rows))
    monkeypatch.setattr(catalog.S, "read_store", lambda spark, path: path)
    catalog.label_store(spark, orders)
    catalog._stores.clear()
    assert len(given) == 2 and not any(reads_raw(rows) for rows in given)


def test_stored_points_are_computed_once(spark, orders, monkeypatch):
    given, write = [], plumbing.S.write_points
    monkeypatch.setattr(plumbing.S, "write_points", lambda points, *a, **k: given.append(points) or write(points, *a, **k))
    all_queries()["numeric_store_round_trip"].build(spark, orders)
    assert len(given) == 2 and not any(reads_raw(points) for points in given)


def test_recent_pairs_are_computed_once(spark, orders):
    out = all_queries()["chart_top_cooccurring_pairs"].build(spark, orders)
    assert not reads_raw(out)
    assert [tuple(r) for r in out.select("label_1", "label_2", "pred_count", "gt_count").collect()] == [("L1", "L2", 1.0, 1.0)]


def test_label_sets_and_confidences_without_lambdas(spark):
    rows = [(["b", None, "", "a", "b"], [0.1, 0.2, 0.3, 0.4, 0.5]), (["b", "a"], [None, 0.4]), (["b", "b"], [None, 0.7]), (None, None), (["a"], [0.1, 0.2])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<string>, c array<double>")
    plan = df.select(labels.named_labels("l").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert [r[0] for r in df.orderBy("i").select(labels.named_labels("l")).collect()] == [["b", "a"], ["b", "a"], ["b"], [], ["a"]]
    scored = df.select("i", labels.scored_labels("l", "c").alias("s"))
    found = {tuple(r) for r in labels.explode_confidences(scored, ["i"], "s").collect()}
    assert found == {(0, "b", 0.1), (0, "a", 0.4), (1, "b", 0.0), (1, "a", 0.4), (2, "b", 0.7), (4, "a", 0.1)}


def test_pairs_of_repeated_inferences_count_once(spark):
    rows = [(day(1), 1, ["a", "b"], ["c"]), (day(1), 1, ["b", "a", "c"], ["c", "d"]), (day(1), 2, ["b", "a"], None)]
    out = M.label_cooccurrence(spark.createDataFrame(rows, "ts timestamp, id int, p array<string>, a array<string>"), ts="ts", row_id="id",
                               predicted="p", actual="a").collect()
    assert {tuple(r)[1:] for r in out} == {("a", "b", 2.0, 0.0), ("a", "c", 1.0, 0.0), ("b", "c", 1.0, 0.0), ("c", "d", 0.0, 1.0)}
