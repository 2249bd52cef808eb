"""Ranked lexical search against brute force and SQL."""

from __future__ import annotations

import functools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm import lexical, queries

DATA = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_numbers_survive_packing():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**31 - 1])
    data, lengths = lexical.packed_numbers(values)
    assert lexical.unpacked_numbers(data).tolist() == values.tolist() and lengths.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert len(lexical.unpacked_numbers(np.zeros(0, np.uint8))) == 0


def test_terms():
    got = lexical.spaced(pa.array(["Ab-cD éÉ 9_x\x00y\x7fz", None, "", "中文 ＡＢ"]).slice(0, 4)).to_pylist()
    assert [t.split() for t in got] == [["ab", "cd", "éÉ", "9", "x", "y", "z"], [], [], ["中文", "ＡＢ"]]
    assert lexical.spaced(pa.array(["Zz", "q Q", "x"]).slice(1, 1)).to_pylist() == ["q q"]


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES["op13_lexical_search"](spark, DATA)
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    same(df.collect(), con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['op13_lexical_search']})").fetchall())


@pytest.mark.parametrize("block", [2, 128])
def test_search_equals_brute_force(spark, monkeypatch, block):
    rnd = random.Random(4)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rnd.randrange(1, 60)))) for i in range(300)]
    # Repeated rows, ids of several texts, no id, no text, a very long text, ties.
    rows += [(3, "W1 w2"), (3, "w1 W2"), (None, "w59 w58"), (None, "w59 w58"), (400, None), (401, ""), (402, " .,"), (403, "w0 " * 50_000),
             (404, "only"), (405, "only"), (406, "only"), (407, "é É w7-w8")]
    items = [(i, " ".join(rnd.sample(words, rnd.randrange(1, 20)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "unknown words"), (33, "only only"), (34, "É w7"), (None, "w3"), (35, "w1"), (35, "w2"), (33, "only")]
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"term": F.lit(1), "shard": F.lit("x"), "n": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit(1), "w": F.lit(0)})
    same(lexical.ranked(docs.repartition(3), asked).collect(), lexical.brute_force(rows, items))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs.limit(0), items.limit(0)).count() == 0


def test_blocks_are_rejected_before_they_are_decoded():
    """A frequent term's blocks are read only where a candidate of the rare term lies."""
    texts = pa.array(["common " + f"x{i} " * (i % 5 + 1) + ("rare " * 3 if i in (700, 5000) else "") for i in range(10_000)])
    rows = lexical.shard_rows(texts, pa.array(range(10_000)), 0, 10_000, 60_000)
    shard = lexical.Shard(pa.Table.from_batches([rows]))
    at, _ = shard.best(["common", "rare"], [1, 9000], 2, 1)
    assert sorted(at.tolist()) == [700, 5000]
    assert shard.decoded == 3 and shard.skipped == -(-10_000 // 128) - 2
    assert len(lexical.Shard(pa.Table.from_batches([rows])).best(["common", "rare"], [1, 9000], 10_000, 1)[0]) == 10_000
    # Block maxima below the bar: nothing of the frequent term is decoded.
    again = lexical.Shard(pa.Table.from_batches([rows]))
    rare = max(again.all(again.row["rare"])[1]) * 9000
    again.decoded = 0
    assert len(again.best(["common", "rare"], [1, 9000], 2, int(rare) + 10**6)[0]) == 0 and again.decoded == 0


ODD_FIRST = [None, "", " rare common", ". common rare", "\n", "\x00b"]


@pytest.mark.parametrize("first", ODD_FIRST)
def test_shards_that_begin_with_no_term(first):
    """A first text that is empty or begins with a separator shifts no list of its shard."""
    texts = [first, "rare b common", "b b", None, " common"]
    rows = lexical.shard_rows(pa.array(texts), pa.array(range(5)), 0, 5, 9)
    rows.validate(full=True)
    shard = lexical.Shard(pa.Table.from_batches([rows]))
    split = [t.split() for t in lexical.spaced(pa.array(texts)).to_pylist()]
    for term in ("rare", "common", "b"):
        docs, impact = shard.all(shard.row[term])
        assert docs.tolist() == [i for i, t in enumerate(split) if term in t] and (impact > 0).all()
        assert shard.blocks(shard.row[term], np.array([0]))[0].tolist() == docs.tolist()


def test_shards_without_any_term():
    rows = lexical.shard_rows(pa.array([None, "", " ."]), pa.array([1, 2, 3]), 0, 5, 9)
    rows.validate(full=True)
    assert rows["n"].to_pylist()[-1] == 0 and rows["doc_ids"].to_pylist()[-1] == [1, 2, 3]
    assert len(lexical.Shard(pa.Table.from_batches([rows])).best(["a"], [5], 3, 0)[0]) == 0


def test_search_of_shards_that_begin_with_no_term(spark):
    rnd = random.Random(5)
    parts = [[(100 * p + i, first if not i else " ".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 9)))) for i in range(20)]
             for p, first in enumerate(ODD_FIRST)]
    parts.append([(900, None), (901, ""), (902, " .,")])
    items = [(1, "a b"), (2, "common"), (3, "h rare"), (4, "none")]
    docs = [spark.createDataFrame(p, "doc_id long, text string").coalesce(1) for p in parts]
    found = lexical.ranked(functools.reduce(DataFrame.unionAll, docs), spark.createDataFrame(items, "item_id long, text string"))
    same(found.collect(), lexical.brute_force([r for p in parts for r in p], items))
