"""Corpus operators against brute force, on edge cases and on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from metricloom.llm import (
    ann, bpe_codec, line_dedup, packing, quality_rules, queries, set_join, substring_dedup, suffix_dedup, token_counts, token_files,
)
from metricloom.llm.encoding import TextEncoder
from metricloom.session import scratch_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
DATA = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
_R = random.Random(5)
LONG = [str(_R.randrange(10**6)) for _ in range(400)]
EDGE = [
    (5, " ".join(LONG)), (3, " ".join(LONG[:120])), (7, "zz " + " ".join(LONG[100:151]) + "\n yy  " + " ".join(LONG[5:20])),
    (8, "q  " + " ".join(LONG[200:249])), (9, "q  " + " ".join(LONG[200:250])), (None, " ".join(LONG)), (10, None), (11, ""),
    (5, " ".join(LONG)), (12, "x " * 140), (13, "x " * 12), (14, "x " * 13), (15, " ".join(LONG)), (16, "a\nb\nc\nd"),
    (17, "x\na\nb\nc"), (18, "b\nc\n\n\nq\nb\nc"), (19, "\n\n\n\n"), (20, "z\nz\nz\nz"), (21, "<|endoftext|> é é #$% ½ \x1c it's"),
    (22, "very " * 9000 + "long"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Extra columns with the names that the operators use inside."""
    df = spark.createDataFrame([(d, t, None if d is None or d % 3 else f"s{d}") for d, t in EDGE],
                               "doc_id long, text string, source string")
    return df.withColumns({"t": F.lit(1), "n": F.lit(None).cast("int"), "_words": F.lit("x"), "h": F.lit(2)}).repartition(3)


def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def pairs_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_text_encoder_gives_the_library_ids():
    texts = [t for _, t in EDGE] + ["İstanbul ŉ ß ẞ ΑΣ. é", "I'LL 12 3.4 ... a.b .a !?", "a\x1cb \x85c\xa0d", "中文 かな", "NAÏVE ǅ ª º ×"]
    encoder = TextEncoder(WORD)
    assert encoder.by_word
    ids, ends = encoder.encode(pa.array(texts))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library_ids(WORD, t)
    assert encoder.counts(pa.array(texts)).tolist() == np.diff(ends).tolist()
    whole = TextEncoder(BYTE)
    assert not whole.by_word and whole.counts(pa.array(texts)).tolist() == [len(library_ids(BYTE, t)) for t in texts]


def test_nearest_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (1, [2.0, 2.0]), (2, [2.0, 2.0]), (3, [1.0, nan]),
            (80, [-1.0, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (100, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1))
    got = ann.search(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 6.0), (0, 2, 2, 6.0), (0, 3, 80, 1.0), (80, 1, 0, 1.0), (80, 2, 1, 0.0), (80, 3, 2, 0.0)]
    assert ann.search(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_nearest_neighbours_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    truth = ann.brute_force(ids, vectors, ids[ids % 20 == 0])
    got = defaultdict(list)
    for r in queries.QUERIES["op1_ann"](spark, DATA).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - vectors[ids == r.query_id][0] @ vectors[ids == r.vec_id][0]) < 1e-12
    assert set(got) == set(truth) and {len(v) for v in got.values()} == {20}
    assert np.mean([len(set(got[q]) & set(t)) / 20 for q, t in truth.items()]) >= 0.9


@pytest.mark.parametrize("copies", [2, 30])
def test_copies_of_an_id_take_one_place(spark, copies):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(30)]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Every second copy is another vector of the id with a lower score for some queries.
    df = spark.createDataFrame([(i, v if c % 2 == 0 else [x / 2 for x in v]) for i, v in rows for c in range(copies)],
                               "vec_id long, embedding array<double>")
    got, scores = defaultdict(list), {}
    for r in ann.search(df, "vec_id = 0", k=20, tables=1, probes=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        scores[r.vec_id] = r.score
    truth = {i: max(a * b * np.dot(rows[0][1], rows[i][1]) for a in (1, 0.5) for b in (1, 0.5)) for i in range(1, 30)}
    assert got[0] == sorted(truth, key=lambda i: -truth[i])[:20] and all(abs(scores[i] - truth[i]) < 1e-9 for i in got[0])
    assert ann.search(once, "vec_id = 0", k=20, tables=1, probes=1).count() == 20


def test_hot_bucket_is_dealt_over_blocks(spark):
    df = spark.createDataFrame([(i, [1.0, i / 1e6]) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.search(df, "vec_id % 20 = 0", block_rows=16, k=3).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]


@pytest.mark.parametrize("source", ["edge", "table"])
def test_line_runs(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    same(line_dedup.removed_lines(df).collect(), line_dedup.brute_force(pairs_of(df)))
    assert line_dedup.remove_lines(df).columns == df.columns
    assert line_dedup.removed_lines(df.limit(0)).count() == 0


def test_single_lines_are_runs(spark):
    rows = [(1, "one line"), (2, "one line"), (3, "p\nshared\nq"), (4, "r\nshared\ns"), (5, "u\n\n \n\nv"), (6, "w\n\n \n\nv"),
            (7, "u\n\n \n\nx"), (8, "y\n\n\n\nz"), (9, "shared\nk\nshared\n\t"), (None, "one line\none line"), (10, "a\nb\nc"), (11, "b\nc\na")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.removed_lines(df).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 4, 7: 4, 8: 0, 9: 2, None: 1, 10: 0, 11: 3}
    same(got, line_dedup.brute_force(rows))
    assert {r.doc_id for r in line_dedup.remove_lines(df).collect()} == {1, 3, 4, 5, 6, 7, 8, 9, None, 10}
    for least in (2, 3):
        same(line_dedup.removed_lines(df, min_lines=least).collect(), line_dedup.brute_force(rows, least))


def test_maximal_runs(spark):
    """Start, length and first copy of each maximal run, against every run of every length."""
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, "\n".join(rnd.choice(["", " ", "a", "b"]) for _ in range(rnd.randrange(1, 12)))) for i in range(25)]
    rows += [(30 + i, "\n".join([f"own {i}", *passage[a:b], "", *passage[c:d]])) for i, (a, b, c, d) in enumerate(
        [(0, 40, 0, 0), (3, 29, 31, 40), (0, 40, 5, 9), (10, 25, 10, 25), (39, 40, 0, 1)])]
    rows += [(None, "a\nb\na\nb"), (50, "z\n" * 11), (51, None), (52, "")]
    lines = {d: t.split("\n") for d, t in rows if t is not None}
    want = {}
    for d, own in lines.items():
        reached = 0
        for i in range(len(own)):
            # The longest run from here on that a smaller document has, or this one earlier, and the first place of it.
            best = (0, None)
            for e, other in lines.items():
                if e != d and (d is None or e is None or e > d):
                    continue
                for j in range(len(other) if e != d else i):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    best = max(best, (n, None if e is None else -e, -j), key=lambda x: tuple(-1000 if y is None else y for y in x))
            n = best[0]
            if n and any(x.strip() for x in own[i:i + n]) and i + n > reached:
                want[d, i] = (n, None if best[1] is None else -best[1], -best[2], max(i, reached))
                reached = i + n
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").withColumn("t", F.xxhash64("text")).repartition(3)
    got = line_dedup.maximal_runs(df).collect()
    assert {(r.doc_id, r.start): (r.length, r.first_doc_id, r.first_start, r.new_from) for r in got} == want
    assert len(got) == len(want) and len(want) > 40
    assert line_dedup.maximal_runs(df.limit(0)).count() == 0


def test_line_runs_of_few_different_lines(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice(["", " ", "\t", "a", "b", "c", "d"]) for _ in range(rnd.randrange(1, 14)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 2, 4, 5):
        same(line_dedup.removed_lines(df, min_lines=least).collect(), line_dedup.brute_force(rows, least))


def test_rules_match_sql_and_policies(spark, edge):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.QUERIES["op3_quality_rules"](spark, DATA)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['op3_quality_rules']})").fetchall()
    same(df.collect(), want)
    rows = quality_rules.judged(quality_rules.ledger(edge))
    by = {(r.doc_id, r.n_words): r for r in rows.collect()}
    assert by[(12, 140)].n_repeat_words == 140 and by[(12, 140)].base_failed and not by[(12, 140)].kept
    assert by[(10, 0)].base_failed and by[(3, 120)].kept and rows.count() == len(EDGE)
    assert quality_rules.filter_documents(edge).columns == edge.columns
    ablation = {(r.policy, r.rule): r for r in quality_rules.ablation(rows).collect()}
    few = ablation[("base", "few_words")]
    assert few.n_failed == sum(r.n_words < 50 for r in rows.collect()) and few.n_removed_alone <= few.n_failed
    assert quality_rules.ledger(edge.limit(0)).count() == 0


@pytest.mark.parametrize("source", ["edge", "table"])
def test_packing(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    rows = packing.pack(df, WORD, bucket_tokens=4000).collect()
    want = sorted(len(library_ids(WORD, t)) + 1 for _, t in pairs_of(df))
    of_sequence, total = defaultdict(list), 0
    for r in rows:
        of_sequence[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(want)
    for s, found in of_sequence.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 2048 or s == max(of_sequence)
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == want
    if source == "table":
        texts = dict(pairs_of(df))
        for r in rows[:200]:
            ids = np.array(library_ids(WORD, texts[r.doc_id]) + [1], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_targets_hold_over_stretches(spark):
    rows = [(i, " ".join(LONG[i % 7:i % 7 + 40]), "small" if i % 10 == 0 else "rest" if i % 10 == 1 else "large") for i in range(400)]
    ids_of = {t: np.array(library_ids(WORD, t) + [1], "<u4") for t in {t for _, t, _ in rows}}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(df, WORD, seq_len=64, window_sequences=4, bucket_tokens=4000, targets={"small": 0.5, "large": 0.5}).collect()
    held, order = defaultdict(int), sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    for r in order:
        held[r.source] += r.length
    assert sum(held.values()) == sum(len(ids_of[t]) for _, t, _ in rows) > 8 * 4000
    given, at = defaultdict(int), 0
    for r in order:
        assert r.sequence_id * 64 + r.offset == at
        given[r.source], at = given[r.source] + r.length, at + r.length
        # A window is 256 ids; where two stretches meet there may be two short ones.
        assert abs(given["small"] - min(at / 2, held["small"])) <= 512
        assert abs(given["rest"] - max(0, at - held["small"] - held["large"])) <= 512
    parts = defaultdict(list)
    for r in pieces:
        parts[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for d, t, _ in rows:
        ids, end = ids_of[t], 0
        for start, n, crc in sorted(parts[d]):
            assert start == end and crc == zlib.crc32(ids[start:start + n].tobytes())
            end += n
        assert end == len(ids)


def test_queues_keep_to_their_shares():
    queues = [[100] * 50, [7] * 300, [5000]]
    share = np.array([sum(q) for q in queues]) / sum(map(sum, queues))
    taken = list(packing.serve(queues, share, np.zeros(3), 0, 1000))
    assert sum(n for _, _, n in taken) == sum(map(sum, queues))
    first = defaultdict(int)
    for s, _, n in taken:
        if sum(first.values()) < 1000:
            first[s] += n
    assert all(abs(first[s] - share[s] * 1000) <= 1 for s in range(3))


@pytest.mark.parametrize("source", ["edge", "table"])
def test_passages(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    found = [tuple(r)[:3] for r in suffix_dedup.repeated_spans(df).collect()]
    assert set(found) == suffix_dedup.brute_force(pairs_of(df))
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0
    assert suffix_dedup.remove_repeated(df).columns == df.columns


def test_passage_cut_keeps_white_space():
    assert suffix_dedup.without("a  b\nc d\te", [(1, 2)]) == "a   d\te"


@pytest.mark.parametrize("source", ["edge", "table"])
def test_token_counts(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    want = []
    for d, t in pairs_of(df):
        n = len(library_ids(WORD, t))
        want.append((d, len((t or "").encode()), n, n > 2048))
    same(token_counts.count_tokens(df, WORD, chunk_chars=3000, overlap_chars=64).collect(), want)
    assert token_counts.count_tokens(df.limit(0), WORD).count() == 0


def test_chunks_widen_until_they_agree():
    tokenizer = Tokenizer.from_file(WORD)
    for text in ("x" * 900 + " " + "y" * 900 + " z", "ab " * 900, "nospace" * 300):
        assert token_counts.count_in_chunks(tokenizer, text, 100, 8) == len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("source", ["edge", "table"])
def test_set_join(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    rows = [r for r in pairs_of(df) if r[0] is not None]
    want = set_join.brute_force(rows) + [(None, 396, None)] * (source == "edge")
    same(set_join.joined(df).collect(), want)
    assert set_join.joined(df.limit(0)).count() == 0


def test_set_join_of_a_large_group_of_near_copies(spark):
    rnd, rows = random.Random(1), []
    for i in range(60):
        w = list(LONG[:120])
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = str(rnd.randrange(10**6))
        rows.append((100 + i, " ".join(w[rnd.randrange(20):])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(set_join.joined(df).collect(), set_join.brute_force(rows))
    assert set_join.keep_one(df).count() == len({c for _, _, c in set_join.brute_force(rows)})


@pytest.mark.parametrize("source", ["edge", "table"])
def test_byte_level_round_trip(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    tokenizer, want = Tokenizer.from_file(BYTE), []
    for d, t in pairs_of(df):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    same(bpe_codec.round_trip(df, BYTE).collect(), want)
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(df, BYTE), BYTE)
    same(back.collect(), [(d, t or "") for d, t in pairs_of(df)])


@pytest.mark.parametrize("source", ["edge", "table"])
def test_windows_of_earlier_documents(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    same(substring_dedup.remove_repeats(df).collect(), substring_dedup.brute_force(pairs_of(df)))
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("source", ["edge", "table"])
def test_token_files(spark, edge, source):
    df = edge if source == "edge" else table(spark)
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(df, path, WORD, block_tokens=5000)
    got = token_files.read_token_files(spark, path, checksums=True).collect()
    order = sorted(pairs_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for d, t in order:
        ids = np.array(library_ids(WORD, t) + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same(got, want)
    one = next(d for d, t in order if d is not None and t)
    assert token_files.read_document(spark, path, one)[0] == library_ids(WORD, dict(order)[one]) + [1]
    empty = scratch_path(spark, "test-token-files")
    token_files.write_token_files(df.limit(0), empty, WORD)
    assert token_files.read_token_files(spark, empty).count() == 0




def test_a_document_is_found_by_the_ranges_of_blocks(spark):
    """Blocks outside the id's range are skipped by their statistics, also beside null ids and ids of several rows."""
    rows = [(None, "no id"), (None, "no id too")] + [(i, f"document {i} " * 30) for i in range(0, 400, 2)] + [(100, "another one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(df, path, WORD, block_tokens=600)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 20
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = token_files.blocks_of(spark, path, 100)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "LessThanOrEqual(first_doc_id,100)" in plan and "GreaterThanOrEqual(last_doc_id,100)" in plan
    inside = blocks.filter("(first_doc_id is null or first_doc_id <= 100) and last_doc_id >= 100").count()
    assert 1 <= inside <= 2
    for d, n in ((0, 1), (100, 2), (398, 1), (99, 0), (1000, 0)):
        want = sorted(library_ids(WORD, t) + [1] for i, t in rows if i == d)
        assert len(want) == n and sorted(token_files.read_document(spark, path, d)) == want


def test_dictionary_is_of_different_texts_and_their_middles(spark):
    same_text = " ".join(LONG)
    rows = [(i, same_text) for i in range(3000)] + [(5000 + i, " ".join(_R.choices(LONG, k=300))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    digest, data = token_files.train_dictionary(df, WORD, 1)
    assert data and (digest, data) == token_files.train_dictionary(df.repartition(2), WORD, 1)
    assert token_files.train_dictionary(df.limit(0), WORD, 1)[1] == b""
