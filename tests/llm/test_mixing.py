"""Mixing to target weights against a step-by-step version, and the laws of the splitting tree."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import mixing, queries
from metricloom.session import scratch_path

DATA = "/root/testdata/sf0.001"
_R = random.Random(2)


def documents(n: int = 300) -> list[tuple]:
    """A hot source, small ones, a null, an empty and a wordless one, repeated rows, null ids, a long text."""
    rows = [(i, " ".join("w" for _ in range(_R.randrange(60))), _R.choice(["a", "a", "a", "b", "c", "é", "Z", "", None])) for i in range(n)]
    rows += [(7, "x y z", "b"), (7, "x y z", "b"), (None, "x y", "a"), (None, "x y", "a"), (500, None, "a"), (501, "", None), (502, "  ", "empty"),
             (503, None, "empty"), (504, "v " * 5000, "b"), (505, "one", "tiny")]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"k": F.lit(1), "size": F.lit("x"), "at": F.lit(0), "target": F.lit(None).cast("int")}).repartition(3)


def results(df):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("block_words", [1, 50, 16_384])
def test_taken_equals_brute_force(spark, block_words):
    rows = documents()
    got = results(mixing.mixture(frame(spark, rows), block_words=block_words).taken())
    want = mixing.brute_force(rows, block_words=block_words)
    assert got == Counter((d, n, s, round(t, 6), k) for d, n, s, t, k in want)
    assert abs(sum(k for *_, k in want) - 1.5 * sum(n for _, n, *_ in want)) < 10


def test_query_over_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    df = queries.QUERIES["op11_source_mixing"](spark, DATA)
    assert results(df) == Counter((d, n, s, round(t, 6), k) for d, n, s, t, k in mixing.brute_force(rows))
    of_source, target = defaultdict(int), {}
    for r in df.collect():
        assert 0 <= r.taken <= 2 * r.size
        of_source[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(of_source[s] - target[s]) <= 0.5 for s in target)


def test_shards_get_what_the_tree_gave(spark):
    rows = documents()
    plan = mixing.mixture(frame(spark, rows), block_words=40, shard_blocks=5, texts=True)
    pieces = plan.pieces().collect()
    taken = Counter()
    for r in plan.taken().collect():
        taken[r.doc_id] += r.taken
    by_shard, words = defaultdict(list), Counter()
    for r in pieces:
        by_shard[r.shard].append(r.position)
        words[r.doc_id] += r.n_words
        assert len(r.text.split()) == r.n_words
    assert words == Counter({d: n for d, n in taken.items() if n})
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    drawn = plan.drawn.collect()
    assert len({(r.k, r.block, r.epoch) for r in drawn}) == len(drawn)
    sizes = Counter(r.shard for r in drawn)
    assert len(sizes) == plan.shards > 10 and max(sizes.values()) - min(sizes.values()) <= 1
    path = scratch_path(spark, "mixture")
    plan.write(path)
    assert spark.read.parquet(path).count() == len(pieces)
    again = mixing.mixture(frame(spark, rows).repartition(7), block_words=40, shard_blocks=5, texts=True).pieces().collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, pieces))


def test_empty_and_wordless_tables(spark):
    empty = frame(spark, documents()).limit(0)
    assert mixing.mixture(empty).taken().count() == 0 and mixing.mixture(empty).pieces().count() == 0
    got = mixing.mixture(frame(spark, [(1, None, "a"), (2, "", None)])).taken().collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("fan, groups", [(2, 1), (3, 4), (256, 2)])
def test_tree_keeps_both_margins(spark, fan, groups):
    quotas = {"a": 500, "b": 31, "c": 1, "d": 90, "e": 7}
    total, shards = sum(quotas.values()), 23
    rows = mixing.shard_counts(spark.createDataFrame(list(quotas.items()), "k string, n long"), shards, total, groups=groups, fan=fan).collect()
    by_source, by_shard = defaultdict(list), Counter()
    for r in rows:
        assert r.hi == r.lo + 1
        by_source[r.k].append((r.lo, r["first"], r.n))
        by_shard[r.lo] += r.n
    assert [by_shard[i] for i in range(shards)] == [(i + 1) * total // shards - i * total // shards for i in range(shards)]
    for k, found in by_source.items():
        at = 0
        for _, first, n in sorted(found):
            assert first == at
            at += n
        assert at == quotas[k]


def test_split_follows_the_hypergeometric_law():
    """Means and variances of what one range gets, over many seeds."""
    counts, capacities = np.array([60, 30, 10]), np.array([20, 20, 20, 20, 20])
    draws = np.array([mixing.hypergeometric_split(counts, capacities, np.random.default_rng(s)) for s in range(4000)])
    assert (draws.sum(axis=1) == counts).all() and (draws.sum(axis=2) == 20).all()
    for j, n in enumerate(counts):
        share = n / 100
        variance = 20 * share * (1 - share) * (100 - 20) / 99
        for i in range(5):
            assert abs(draws[:, i, j].mean() - 20 * share) < 5 * (variance / 4000) ** 0.5
            assert abs(draws[:, i, j].var() / variance - 1) < 0.15
