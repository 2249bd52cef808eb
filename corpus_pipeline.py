"""A training-data pipeline of corpus operators over the documents table.

Each stage reads what the one before wrote. All but the last return the columns of
documents; the last returns the pieces of packed sequences. When a stage begins, the
result of the one before is written, so the scratch tables behind it are deleted, but
for those that the documents given to it still read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricloom.llm import line_dedup, packing, quality_rules, set_join, suffix_dedup
from metricloom.llm.storage import drop_tables, read_table, stage, tables_made

_scratch: list[str] = []


def _step(f: Callable) -> Callable:
    @functools.wraps(f)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch[:] = drop_tables(spark, _scratch, docs)
        with tables_made() as made:
            out = f(spark, docs, sf_dir)
        _scratch.extend(made)
        return out

    return run_step


@_step
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail a rule of policy v1, null and empty texts among them.

    Rows are judged one by one, so repeated rows and null ids fare alike.
    """
    return quality_rules.filter_documents(docs)


@_step
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that lose their last word.

    Rows with a null id lose only copies within themselves; rows of one id keep each other's lines.
    """
    return line_dedup.remove_lines(docs)


@_step
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows with a null id and texts without words stay; repeated rows of the kept id stay together.
    """
    return set_join.keep_one(docs)


@_step
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document has go, and documents that lose their last word.

    Rows with a null id neither lose nor remove anything.
    """
    return suffix_dedup.remove_repeated(docs)


@_step
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with the sources in their proportions; every row is packed, a null source is a source."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("set_join", near_duplicates),
    ("suffix_dedup", passages),
    ("packing", packed),
]
# Minimisers, hashes and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
