"""The pipeline's stages against a chain of the operators' brute-force versions."""

from __future__ import annotations

import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from metricloom.llm import line_dedup, quality_rules, set_join, suffix_dedup
from metricloom.session import scratch_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
DATA = "/root/testdata/sf0.001"
ENCODER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
_R = random.Random(8)
WORDS = [f"w{_R.randrange(10**5)}" for _ in range(3000)]


def stretch(a: int, b: int, line: int = 12) -> str:
    return "\n".join(" ".join(WORDS[i:min(i + line, b)]) for i in range(a, b, line))


EDGE = [
    (1, stretch(0, 400)), (2, stretch(0, 400)), (3, stretch(60, 460)), (4, None), (5, ""), (6, "x " * 90), (None, stretch(0, 400)),
    (None, stretch(1000, 1200)), (7, stretch(1000, 1200)), (7, stretch(1000, 1200)), (8, stretch(1500, 1600) + "\n" + stretch(100, 160, 70)),
    (9, "\n".join(f"{w} {w}a {w}b" for w in WORDS) * 2), (10, " ".join(f"t{i}" for i in range(20_000))), (11, stretch(2000, 2049)),
]


def expected(rows: list[tuple]) -> list[list[tuple]]:
    """What each filtering stage keeps, as (doc_id, text)."""
    out = [[(d, t) for d, t in rows if not quality_rules.brute_force(t)[1]]]
    lines = line_dedup.brute_kept(out[-1])
    out.append([(d, kept) for (d, _, gone, kept) in lines if not gone or kept.split()])
    known = [(d, t) for d, t in out[-1] if d is not None]
    component = {d: c for d, _, c in set_join.brute_force(known)}
    out.append([(d, t) for d, t in out[-1] if d is None or component[d] == d])
    # Rows of one id are told apart by their text; equal rows have equal spans.
    spans = defaultdict(set)
    for d, t, start, n in brute_spans(out[-1]):
        spans[d, t].add((start, n))
    cut = [(d, suffix_dedup.without(t, sorted(spans[d, t])) if spans.get((d, t)) else t, bool(spans.get((d, t)))) for d, t in out[-1]]
    out.append([(d, t) for d, t, changed in cut if not changed or t.split()])
    return out


def brute_spans(rows):
    numbers = {i: row for i, row in enumerate(rows)}
    for i, (d, t) in numbers.items():
        others = [r for j, r in numbers.items() if j != i and r[0] is not None and d is not None and r[0] < d]
        for e, start, n in suffix_dedup.brute_force([*others, (d, t)]):
            if e == d:
                yield d, t, start, n


def run_stages(spark, docs):
    found = []
    for _, step in corpus_pipeline.STAGES:
        path = scratch_path(spark, "test-stage")
        step(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


@pytest.mark.parametrize("source", ["edge", "table"])
def test_stages_equal_brute_force(spark, source):
    if source == "table":
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
    else:
        docs = spark.createDataFrame([(d, t, "en", None if i % 3 else "s", i) for i, (d, t) in enumerate(EDGE)],
                                     "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        docs = docs.withColumns({"failed_rules": F.lit("x"), "_words": F.lit(1), "t": F.lit(2), "component_id": F.lit(3), "lines": F.lit(0)})
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = run_stages(spark, docs)
    for (name, _), got, want in zip(corpus_pipeline.STAGES, found, expected(rows), strict=False):
        assert got.columns == docs.columns, name
        assert Counter(tuple(r) for r in got.select("doc_id", "text").collect()) == Counter(want), name
    kept = expected(rows)[-1]
    ids = Counter((d, tuple([*ENCODER.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in kept)
    by_document = defaultdict(list)
    for r in found[-1].collect():
        by_document[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for (d, tokens), n in ids.items():
        if sum(k for (e, _), k in ids.items() if e == d) > 1:
            continue
        at = 0
        for start, length, crc, total in sorted(by_document[d]):
            assert (start, total) == (at, len(tokens)) and crc == zlib.crc32(np.array(tokens[at:at + length], "<u4").tobytes())
            at += length
        assert at == len(tokens) and n == 1
    assert sum(length for p in by_document.values() for _, length, _, _ in p) == sum(len(t) * n for (_, t), n in ids.items())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert [df.count() for df in run_stages(spark, docs)] == [0] * 5


def test_long_texts_take_seconds(spark):
    """Work grows with the text, not with its square."""
    long = " ".join(f"v{i}" for i in range(40_000))
    many_lines = "\n".join(f"line {i} of many" for i in range(32_000))
    docs = spark.createDataFrame([(1, long), (2, many_lines), (3, many_lines + "\nlast")], "doc_id long, text string")
    began = time.time()
    assert quality_rules.filter_documents(docs).count() == 1
    assert {r.doc_id: r.text[-4:] for r in line_dedup.remove_lines(docs).collect()} == {1: "9999", 2: "many", 3: "last"}
    assert time.time() - began < 30


def test_scratch_tables_go_when_the_next_stage_begins(spark):
    docs = spark.createDataFrame([(1, stretch(0, 90), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.quality(spark, docs, DATA)
    left = list(corpus_pipeline._scratch)
    # Not written between the stages: what is still read stays.
    second = corpus_pipeline.lines(spark, first, DATA)
    assert left and set(left) <= set(corpus_pipeline._scratch) and second.count() == 1
    corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert not set(left) & set(corpus_pipeline._scratch)
