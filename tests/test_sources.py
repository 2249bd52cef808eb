from __future__ import annotations

import json
from datetime import date, datetime

import pandas as pd
import pytest

from metricloom.sources import readers, writers
from tests.conftest import day


def test_dated_parquet_with_nanosecond_times(spark, tmp_path):
    for d in (1, 2):
        folder = tmp_path / f"2024-01-0{d}"
        folder.mkdir()
        frame = pd.DataFrame({"timestamp": pd.to_datetime([f"2024-01-0{d} 05:00:00"], utc=True), "id": [d]})
        frame.to_parquet(folder / f"data-2024-01-0{d}.parquet")
    rows = readers.read_dated_parquet(spark, str(tmp_path), "timestamp timestamp, id long",
                                      nanosecond_columns=["timestamp"]).orderBy("id").collect()
    assert [(r["timestamp"], r["file_date"]) for r in rows] == [(day(1, 5), date(2024, 1, 1)), (day(2, 5), date(2024, 1, 2))]


def test_json_arrays_in_hive_folders(spark, tmp_path):
    folder = tmp_path / "year=2024" / "month=01" / "day=03"
    folder.mkdir(parents=True)
    rows = [{"timestamp": "2024-01-03T04:05:06Z", "fraud_score": 0.5}, {"timestamp": "not a time", "fraud_score": 0.1}]
    (folder / "inferences_hour=04.json").write_text(json.dumps(rows))
    df = readers.read_partitioned_json(spark, str(tmp_path), "timestamp string, fraud_score double, year int, month int, day int")
    parsed = readers.parse_timestamps(df, "timestamp").orderBy("fraud_score").collect()
    assert parsed[0]["timestamp"] is None and parsed[1]["timestamp"] == datetime(2024, 1, 3, 4, 5, 6)
    assert parsed[0]["day"] == 3


def test_csv_in_dated_folders(spark, tmp_path):
    folder = tmp_path / "2024-01-05"
    folder.mkdir()
    (folder / "data-2024-01-05.csv").write_text("a;b\n1;'x;y'\n")
    row = readers.read_csv(spark, str(tmp_path), "a int, b string", sep=";", quote="'", date_column="d").first()
    assert tuple(row) == (1, "x;y", date(2024, 1, 5))


@pytest.mark.parametrize("prefix, start, end, zone, expected", [
    ("d/%Y/%m/%d", datetime(2024, 1, 30, 23), datetime(2024, 2, 1), "UTC", ["d/2024/01/30", "d/2024/01/31"]),
    ("d/%Y/%m", datetime(2024, 1, 30), datetime(2024, 2, 2), "UTC", ["d/2024/01", "d/2024/02"]),
    ("%H", datetime(2024, 1, 1, 3, 59), datetime(2024, 1, 1, 5), "UTC", ["03", "04"]),
    ("d/%d", datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 4), "America/New_York", ["d/01"]),
    ("fixed", datetime(2024, 1, 1), datetime(2024, 1, 2), "UTC", ["fixed"]),
])
def test_prefix_expansion(prefix, start, end, zone, expected):
    assert readers.expand_prefix(prefix, start, end, zone) == expected


def test_window_reads_only_its_folders(spark, tmp_path):
    for d in (1, 2, 3):
        folder = tmp_path / f"2024/01/0{d}"
        folder.mkdir(parents=True)
        (folder / "rows.json").write_text(json.dumps([{"id": d}]))
        (folder / "rows.tmp").write_text(json.dumps([{"id": 100 + d}]))
    args = dict(schema="id int", file_type="json")
    df = readers.read_window(spark, str(tmp_path), "%Y/%m/%d", r".*\.json", start=day(2), end=day(4), **args)
    assert sorted(r["id"] for r in df.collect()) == [2, 3]
    none = readers.read_window(spark, str(tmp_path), "%Y/%m/%d", r".*\.json", start=day(20), end=day(21), **args)
    assert none.count() == 0


def test_window_of_a_year_by_minutes_is_listed_once(spark, tmp_path, monkeypatch):
    """Half a million possible folders, four that exist: one listing, whatever the window's length."""
    calls = []
    listed = readers.list_folders
    monkeypatch.setattr(readers, "list_folders", lambda s, p: calls.append(p) or listed(s, p))
    for n, name in enumerate(("year=2024/m-01/01/00/00", "year=2024/m-07/31/23/59", "year=2024/m-12/31/23/58", "year=2025/m-01/01/00/00")):
        folder = tmp_path / "da{t}a" / name
        folder.mkdir(parents=True)
        (folder / "rows.json").write_text(json.dumps([{"id": n}]))
    df = readers.read_window(spark, str(tmp_path), "da{t}a/year=%Y/m-%m/%d/%H/%M", r".*\.json", start=day(1),
                             end=datetime(2025, 1, 1), schema="id int", file_type="json")
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 2] and len(calls) == 1
    assert calls[0].endswith("/da\\{t\\}a/year=2024/m-[0-9][0-9]/[0-9][0-9]/[0-9][0-9]/[0-9][0-9]")
    assert readers.existing(spark, str(tmp_path), "x", []) == []
    assert readers.prefix_glob("a/%b-%d", ["a/Jan-01", "a/Feb-01"]) == "a/*-[0-9][0-9]"


def test_inspection_and_tags(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ts,score\n2024-01-01,0.5\n2024-01-02,0.7\n")
    schema = readers.inspect_schema(spark, str(tmp_path), file_type="csv", sampling=1.0)
    assert dict((f.name, f.dataType.simpleString()) for f in schema) == {"ts": "date", "score": "double"}
    marked = readers.tagged(schema, {"ts": ["primary_timestamp"]})
    assert readers.columns_with_tag(marked, "primary_timestamp") == ["ts"]


def test_locations_and_warehouse_options():
    assert readers.object_store_uri("s3", "b", "/x/y") == "s3a://b/x/y" and readers.object_store_uri("gcs", "b") == "gs://b"
    fmt, options = readers.warehouse_options("jdbc", host="h", port=5432, database="d", username="u", password="p", table="t",
                                             partitionColumn="id", lowerBound=0, upperBound=9, numPartitions=3)
    assert fmt == "jdbc" and options["url"] == "jdbc:postgresql://h:5432/d" and options["numPartitions"] == "3"
    assert readers.warehouse_options("bigquery", project_id="p", table="t")[1] == {"parentProject": "p", "table": "t"}
    with pytest.raises(ValueError):
        readers.warehouse_options("other")


def test_date_partitioned_writer(spark, tmp_path):
    df = spark.createDataFrame([(day(1, 3), 1), (day(2, 4), 2)], "ts timestamp, v int")
    writers.write_by_date(df, str(tmp_path / "out"), ts="ts")
    assert sorted(p.name for p in (tmp_path / "out").glob("partition_date=*")) == [
        "partition_date=2024-01-01", "partition_date=2024-01-02"]
