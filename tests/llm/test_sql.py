"""The SQL twins of the corpus operators: against the queries on the smallest tables, against brute force on edge cases."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pytest

from metricloom.llm import line_dedup, queries, set_join, substring_dedup

DATA = "/root/testdata/sf0.001"
LONG = [f"w{i * i % 997}" for i in range(90)]
ROWS = [
    (1, " ".join(LONG)), (2, "a b c\n" + " ".join(LONG[5:60]) + "\n\n \nq r s"), (3, " ".join(LONG).upper()), (4, None), (5, ""), (6, "x " * 40),
    (7, "u\n\n \n\nv"), (8, "w\n\n \n\nv"), (9, "u\n\n \n\nx"), (10, "shared\nk\nshared\n\t"), (11, " \x0b\t\n"), (12, " ".join(LONG[:88])),
    (13, "a b c"), (14, "A b\x0cC"), (15, "shared"), (16, " ".join(LONG[20:33])), (17, "w0 w1\x1cw2 é ½ " * 4),
]
FORCED = {"op2_line_dedup": line_dedup.brute_force, "op7_set_join": set_join.brute_force, "op9_substring_dedup": substring_dedup.brute_force}


def same(a, b):
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_set_join", "op9_substring_dedup"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    same(df.collect(), con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall())


@pytest.mark.parametrize("name", FORCED)
@pytest.mark.parametrize("repeats", [1, 2])
def test_sql_matches_brute_force(name, repeats):
    if repeats > 1 and name == "op7_set_join":
        pytest.skip("its brute force takes each id once")
    con = duckdb.connect()
    rows = ROWS * repeats
    documents = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    con.register("documents", documents)
    same(con.execute(queries.SQL[name]).fetchall(), FORCED[name](rows))


def test_sql_of_an_empty_table():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    for name in FORCED:
        assert con.execute(queries.SQL[name]).fetchall() == []
