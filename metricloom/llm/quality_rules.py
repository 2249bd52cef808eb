"""Rule bitmask ledger: every rule once per document, policies and ablations by bit operations.

``ledger`` measures each text in one pass without a shuffle and keeps the failed rules
as the bits of one number. A policy is a named, versioned mask of rules: a document is
kept if none of the mask's bits is set. Changing a policy, or asking what a rule alone
removes, reads ledger rows only, never texts.

Only DataFrame functions run here. Windows of three words are compared by a 64-bit
hash inside one document; sorting (hash, place) puts equal windows side by side.

Defined results: null or empty text has no words and no lines, so it fails ``few_words``.
Rows are judged one by one: repeated rows and null ids give a row each. Names of other
columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.storage import stage

SPACE = r"[ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails`` (SQL over the measures) holds. The bit is the rule's place for good."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 20 * word_chars"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)


def mask_of(*names: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in set(names))


#: Versioned policies; a version is never edited, a new one is added.
POLICIES = {
    "base": mask_of("few_words", "repeated_words"),
    "v1": mask_of("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures as long columns; keeps every column of ``docs``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    with_words = docs.withColumn("_words", F.array_remove(F.split(t, SPACE + "+"), ""))

    def window(i: Column) -> Column:
        words = F.col("_words")
        return F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))

    places = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    with_windows = with_words.withColumn("_sorted", F.sort_array(F.transform(places, window)))

    def has_twin(x: Column, i: Column) -> Column:
        # Each array is named several times, so the optimizer keeps it as a column instead of computing it for each element.
        return (x["h"] == F.get(F.col("_sorted"), i - 1)["h"]) | (x["h"] == F.get(F.col("_sorted"), i + 1)["h"])

    repeated = F.flatten(F.transform(F.filter("_sorted", has_twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    with_lines = with_windows.withColumn("_repeated", repeated).withColumn(
        "_lines", F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^ \t-\r]")))
    return with_lines.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.size(F.array_distinct("_repeated")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    }).drop("_words", "_sorted", "_repeated", "_lines")


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the measures and ``failed_rules`` of each row."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return measured(plain).select("doc_id", *MEASURES).withColumn("failed_rules", failure_bits())


def passes(policy: str, bits: str = "failed_rules") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def judged(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to ledger rows; what fails the base policy is never kept."""
    return rows.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def stored_ledger(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` beside their ledger in a written table: columns ``c0, c1, ..``, the measures and ``failed_rules``.

    Policies read the stored bits alone. A filter on the computed ones would be moved below
    the projections and compute each text's arrays once for every window.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return stage(measured(inner, f"c{names.index(text)}").withColumn("failed_rules", failure_bits()), "rule-ledger")


def filter_documents(docs: DataFrame, *, text: str = "text", policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only.

    Null and empty texts have few words and go; repeated rows are judged alike; an empty table stays empty.
    """
    kept = stored_ledger(docs, text=text).filter(passes("base") & passes(policy))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def ablation(rows: DataFrame, policies: Mapping[str, int] | None = None) -> DataFrame:
    """For each policy and rule: documents it fails, and documents it alone removes under the policy.

    Ledger rows are first counted for each bit pattern (at most two to the number of rules).
    """
    patterns = rows.groupBy("failed_rules").agg(F.count("*").alias("n"))
    cases = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r.name).alias("rule"),
                 F.lit(1 << r.bit).cast("long").alias("bit"))
        for p, m in (policies or POLICIES).items() for r in RULES if m >> r.bit & 1
    ])
    each = patterns.select("failed_rules", "n", F.explode(cases).alias("c")).select("failed_rules", "n", "c.*")
    hit = F.col("failed_rules").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("failed_rules").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_removed_alone"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_removed_by_policy"),
    )


def brute_force(text: str | None) -> tuple[dict[str, int], set[str]]:
    """The measures of a text and the names of the rules that it fails, by the definition; for tests."""
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(SYMBOLS, t)),
         "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}
    fails = {
        "few_words": m["n_words"] < 50, "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 100 * m["n_symbols"] > 20 * m["word_chars"], "duplicate_lines": 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "word_length": m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 20 * m["n_words"],
    }
    return m, {name for name, failed in fails.items() if failed}
