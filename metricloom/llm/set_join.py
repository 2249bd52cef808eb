"""N-gram Jaccard join with set relations: components of documents that share three quarters of their shingles.

Every link of 0.75 or more counts, none is listed twice, and no group is paired off:

1. Documents of equal sets are one set; only the smallest id goes on.
2. Skipping by position. All sets are ordered by hash. Of a set of n shingles the first
   ``n - ceil(3n/4) + l(n)`` are looked at, with ``l(n) = 1 + n // 20``: two linked sets share
   at least ``l`` shingles among those, so a set with fewer repeated ones has no partner.
   Next the sets left are looked at whole: ``ceil(3n/4)`` of their shingles must be repeated.
3. Lists of (shingle, size block) skip every block whose sizes cannot link. Each list has a
   pivot, and its members are compared with the pivots of their own and the next smaller block.
   Links to pivots give components. Sets close to the centre of a group of similar ones are linked
   without being compared: what each differs in from the centre bounds what two of them differ in.
4. Answers from similar sets. What is left are links between components. Shingles inside
   one component cannot make one, so sets are ordered by the number of components that hold
   a shingle, and only sets with ``ceil(3n/4)`` shingles in several components go on. They meet
   in lists of (shingle, narrow size block) where the positions leave ``ceil(3(n + m)/7)``
   shared shingles to both. For a pair of those, the overlap of their pivots a and b is computed once for all pairs with
   the same pivots: ``|x n y| <= |a n b| + |x - a| + |y - b|`` skips the pair or not. Pairs not
   skipped are compared exactly.

A shingle's rows are summed inside a batch before they are shuffled, and joins on
shingles or documents are plain shuffle joins that Spark splits where a key is hot.

Defined results: null or empty text has an empty set and no links. Texts of fewer than five
words are one shingle of all their words. Rows with a null id take no part and have a null
component. Rows that share an id are one node with the links of each row; repeated rows
give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.spans import Batch
from metricloom.llm.storage import stage
from metricloom.llm.words import as_array, mix, slices, window_hashes

WORDS = 5
#: Pivots that a document is compared with in step 3; step 4 is exact for whatever they miss.
PIVOTS = 3
#: Ratio of the sizes that one block of step 4 spans.
NARROW = 1.05
ROWS = "doc_id long, h long, proven boolean, n long"


def least(n: int) -> int:
    """Shingles that a set of ``n`` shares with any set it links with."""
    return -(-3 * n // 4)


def extra(n: int) -> int:
    return 1 + n // 20


def sets_of(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    words = Batch.of(pc.ascii_lower(pc.fill_null(texts, "")))
    inner = window_hashes(words.hashes, width)
    found = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= width:
            found.append(np.unique(inner[a:b - width + 1].view(np.int64)))
        else:
            found.append(window_hashes(words.hashes[a:b], b - a).view(np.int64) if b > a else np.zeros(0, np.int64))
    return found


def described(plain: DataFrame) -> DataFrame:
    """``doc_id, n`` and two hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(as_array(batch.column(1))):
                sets = sets_of(batch.column(1).slice(a, b - a))
                keys = [[int(mix(s.view(np.uint64) + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64())], ["doc_id", "n", "s1", "s2"])

    return plain.mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def summed_rows(ids: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows that tell which shingles are repeated, a shingle once for each batch.

    A shingle of several sets of the batch is proven repeated: its sets get their count
    of such shingles at once, and one row without an id stands for it elsewhere.
    """
    flat = np.concatenate([*sets, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    distinct, first, where, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    single = counts == 1
    proven = np.bincount(owner[~single[where]], minlength=len(sets))
    have = np.flatnonzero(proven)
    alone = ids[owner[first[single]]]
    shared = distinct[~single]
    n = len(alone) + len(shared)
    doc = pa.array(np.concatenate([alone, np.zeros(len(shared), np.int64), ids[have]]),
                   mask=np.concatenate([np.zeros(len(alone), bool), np.ones(len(shared), bool), np.zeros(len(have), bool)]))
    h = np.concatenate([distinct[single], shared, mix(ids[have].view(np.uint64)).view(np.int64)])
    return pa.RecordBatch.from_arrays([
        doc, pa.array(h), pa.array(np.arange(n + len(have)) >= n),
        pa.array(np.concatenate([np.ones(n, np.int64), proven[have]])),
    ], ["doc_id", "h", "proven", "n"])


def repeated_counts(rows: DataFrame) -> DataFrame:
    """``doc_id, repeated``: how many of a document's shingles lie in other documents too."""
    seen = F.count("*").over(Window.partitionBy("h"))
    each = rows.select("doc_id", F.when(F.col("proven"), F.col("n")).when(seen > 1, 1).otherwise(0).alias("c"))
    return each.filter("doc_id is not null and c > 0").groupBy("doc_id").agg(F.sum("c").alias("repeated"))


def first_rows(plain: DataFrame) -> DataFrame:
    """Summed rows of the first shingles of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(as_array(batch.column(1))):
                sets = sets_of(batch.column(1).slice(a, b - a))
                yield summed_rows(batch.column(0).slice(a, b - a).to_numpy(),
                                  [s[:len(s) - least(len(s)) + extra(len(s))] for s in sets])

    return plain.mapInArrow(run, ROWS)


def whole_sets(plain: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(as_array(batch.column(1))):
                sets = sets_of(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "n", "shingles"])

    return plain.mapInArrow(run, "doc_id long, n long, shingles array<long>")


def whole_rows(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            yield summed_rows(batch.column(0).to_numpy(), [x.values.to_numpy() for x in lists])

    return sets.select("doc_id", "shingles").mapInArrow(run, ROWS)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with both sizes and the size of the intersection; the larger of several where ids are shared."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))


LINKED = "100 * common >= 75 * (n_a + n_b - common)"


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, component``: smallest id reachable over ``a, b``, for every id that has an edge.

    Labels spread to neighbours and jump to the label's own label, so rounds grow with the
    logarithm of a component's width; each round is written out.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("doc_id")).agg(
            F.min("component").alias("seen"))
        spread = labels.join(near, "doc_id").select("doc_id", F.col("component").alias("was"),
                                                    F.least("component", "seen").alias("component"))
        up = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("above"))
        after = stage(spread.join(up, "component").select("doc_id", "was", F.least("component", "above").alias("component")), "labels")
        labels = after.drop("was")
        if after.filter("component <> was").isEmpty():
            return labels


def size_block(n: str) -> Column:
    """Linked sets lie in the same or neighbouring blocks."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(4 / 3))).cast("int")


def pivot_links(sets: DataFrame) -> DataFrame:
    """``a`` (a document), ``b`` (a pivot) and their overlap, for up to ``PIVOTS`` pivots of each document."""
    first = F.expr("slice(shingles, 1, cast(n - ceil(3 * n / 4) + 1 as int))")
    rows = sets.select("doc_id", size_block("n").alias("block"), F.explode(first).alias("h"))
    pivots = stage(rows.groupBy("h", "block").agg(F.min("doc_id").alias("b"), F.count("*").alias("size")), "pivots")
    asked = rows.select(F.col("doc_id").alias("a"), "h", F.explode(F.array("block", F.col("block") - 1)).alias("block"))
    met = asked.join(pivots.drop("size"), ["h", "block"]).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("met"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("met"), "b"))
    return overlaps(met.withColumn("rank", best).filter(F.col("rank") <= PIVOTS).select("a", "b"), sets)


def star_links(sets: DataFrame, pivots: DataFrame) -> DataFrame:
    """Links ``a, b`` of sets that lie close to one centre, known without comparing them with each other.

    Sets with the same best pivot form a group, and its centre holds the shingles that most of them have. Two
    sets that each differ from a centre in at most a seventh of their own size differ from one another in
    at most a seventh of both sizes, which is a link. Each names the smallest id around its centre; groups
    with equal centres are one.
    """
    best = pivots.groupBy("a").agg(F.max(F.struct("common", "b")).alias("p")).select(
        F.col("a").alias("doc_id"), F.col("p.b").alias("pivot"))
    group = stage(best.union(best.select("pivot", "pivot")).distinct(), "star-groups")
    grouped = stage(sets.join(group, "doc_id"), "star-sets")
    sizes = grouped.groupBy("pivot").agg(F.count("*").alias("size"))
    counts = grouped.select("pivot", F.explode("shingles").alias("h")).groupBy("pivot", "h").agg(F.count("*").alias("held"))
    centres = counts.join(sizes, "pivot").filter("2 * held > size").groupBy("pivot").agg(F.sort_array(F.collect_list("h")).alias("centre"))
    centres = stage(centres.withColumn("c1", F.xxhash64("centre")).withColumn("c2", F.hash("centre")), "star-centres")
    apart = F.col("n") + F.size("centre") - 2 * F.size(F.array_intersect("shingles", "centre"))
    around = grouped.join(centres, "pivot").filter(7 * apart <= F.col("n")).select("c1", "c2", "doc_id").distinct()
    around = stage(around, "star-members")
    smallest = stage(around.groupBy("c1", "c2").agg(F.min("doc_id").alias("b"), F.count("*").alias("held")).filter("held > 1"), "stars")
    return around.join(smallest, ["c1", "c2"]).filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")


def narrow_block(n: str) -> Column:
    return F.floor(F.log(F.col(n)) / F.log(F.lit(NARROW))).cast("int")


def open_pairs(ready: DataFrame) -> DataFrame:
    """Pairs ``a, b, n_a, n_b`` of different components whose shared shingles leave room for a link.

    Linked sets of n and m shingles have ``ceil(3 (n + m) / 7)`` in common, all of them shared,
    so the first of those lies before the last ``ceil(3 (n + m) / 7) - 1`` shared ones of both.
    Of the two, ``a`` is the smaller and is listed for partners of its own size at least; ``b``
    asks each block of sizes with as many shingles as the smallest size in it allows.
    """
    own = F.expr("cast(ceil(6 * n / 7) as int)")
    listed = ready.filter(F.col("shared") >= own).select(
        F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"), F.col("shared").alias("t_a"),
        narrow_block("n").alias("block"), F.posexplode(F.slice("tokens", F.lit(1), F.col("shared") - own + 1)).alias("at_a", "h"))
    blocks = ready.withColumn("least", F.ceil(3 * F.col("n") / 4)).withColumn(
        # One block more at each end, and one less for its smallest size, keep rounding out of the answer.
        "block", F.explode(F.sequence(narrow_block("least") - 1, narrow_block("n") + 1)))
    smallest = F.greatest("least", F.floor(F.pow(F.lit(NARROW), F.col("block"))) - 1)
    asking = blocks.withColumn("room", (F.col("shared") - F.ceil(3 * (F.col("n") + smallest) / 7) + 1).cast("int"))
    asked = asking.filter("room > 0").select(
        F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), F.col("shared").alias("t_b"),
        "block", F.posexplode(F.slice("tokens", F.lit(1), F.col("room"))).alias("at_b", "h"))
    fits = ("(n_a < n_b or n_a = n_b and a < b) and c_a <> c_b and 4 * n_a >= 3 * n_b "
            "and 7 * (t_a - at_a) >= 3 * (n_a + n_b) and 7 * (t_b - at_b) >= 3 * (n_a + n_b)")
    return listed.join(asked, ["h", "block"]).filter(fits).select("a", "b", "n_a", "n_b").distinct()


def between_components(sets: DataFrame, pivots: DataFrame, labels: DataFrame) -> DataFrame:
    """Links ``a, b`` of documents in different components."""
    known = sets.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = known.select("doc_id", "n", "component", F.explode("shingles").alias("h"))
    several = rows.select("h", "component").distinct().groupBy("h").agg(F.count("*").alias("held")).filter("held > 1")
    several = stage(several, "shared-shingles")
    shared = rows.join(several, "h").groupBy("doc_id", "n", "component").agg(
        F.sort_array(F.collect_list(F.struct("held", "h"))).alias("tokens"))
    ready = shared.select("doc_id", "n", "component", F.size("tokens").alias("shared"), F.col("tokens.h").alias("tokens"))
    ready = stage(ready.filter("shared >= ceil(3 * n / 4)"), "open-sets")
    pairs = stage(open_pairs(ready), "open-pairs")
    # The nearest pivot of each document and how much of the document it lacks.
    near = pivots.filter(LINKED).groupBy("a").agg(F.max(F.struct("common", "b")).alias("p"))
    own = sets.select("doc_id", "n").join(near.withColumnRenamed("a", "doc_id"), "doc_id", "left").groupBy("doc_id").agg(
        F.max(F.coalesce("p.b", "doc_id")).alias("p"), F.max(F.coalesce(F.col("n") - F.col("p.common"), F.lit(0))).alias("lacks"))
    of_a = own.select(F.col("doc_id").alias("a"), F.col("p").alias("p_a"), F.col("lacks").alias("lacks_a"))
    of_b = own.select(F.col("doc_id").alias("b"), F.col("p").alias("p_b"), F.col("lacks").alias("lacks_b"))
    asked = stage(pairs.join(of_a, "a").join(of_b, "b"), "asked-pairs")
    answers = overlaps(asked.select(F.col("p_a").alias("a"), F.col("p_b").alias("b")).distinct(), sets)
    answers = answers.groupBy(F.col("a").alias("p_a"), F.col("b").alias("p_b")).agg(F.max("common").alias("known"))
    open_ = asked.join(answers, ["p_a", "p_b"]).withColumn("common", F.col("known") + F.col("lacks_a") + F.col("lacks_b"))
    return overlaps(open_.filter("7 * common >= 3 * (n_a + n_b)").select("a", "b").distinct(), sets).filter(LINKED).select("a", "b")


def joined(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    base = stage(described(plain), "sets-base")
    real = base.filter("doc_id is not null and n > 0")
    reps = stage(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "sets-reps")
    equal = real.join(reps, ["s1", "s2", "n"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    chosen = reps.select(F.col("rep").alias("doc_id"), "n").groupBy("doc_id").agg(F.min("n").alias("n"))
    numbered = plain.filter("doc_id is not null")
    counts = repeated_counts(first_rows(numbered))
    enough = "repeated >= 1 + floor(ceil(3 * n / 4) / 20)"
    # Written first, so that its size is known: a short list is broadcast and the texts stay where they are.
    some = stage(counts.join(chosen, "doc_id").filter(enough).select("doc_id"), "ids-some")
    sets = stage(whole_sets(numbered.join(some, "doc_id")), "sets-some").filter("n > 0")
    whole = repeated_counts(whole_rows(sets))
    left = whole.join(sets.groupBy("doc_id").agg(F.min("n").alias("n")), "doc_id").filter("repeated >= ceil(3 * n / 4)")
    sets = stage(sets.join(stage(left.select("doc_id"), "ids-left"), "doc_id"), "sets-left")
    pivots = stage(pivot_links(sets), "pivot-links")
    links = stage(pivots.filter(LINKED).select("a", "b").union(star_links(sets, pivots)), "first-links")
    labels = components(links)
    more = between_components(sets, pivots, labels)
    final = components(links.union(more).union(equal))
    return base.join(final, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    d, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    gone = joined(inner, doc_id=d, text=t).filter("component_id < doc_id").select("doc_id").distinct()
    return inner.join(gone, F.col(d) == F.col("doc_id"), "left_anti").toDF(*names)


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """The definition over all pairs; for tests."""
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else ({tuple(w)} if w else set()))
    parent: dict[int, int] = {d: d for d, _ in rows}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                    parent[y] = x
    return [(d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)]
