"""Mixing sources to target weights: exact block quotas split over output shards by a multivariate-hypergeometric tree.

1. Targets. Source ``i`` in code-point order (null last) weighs ``weights[i % len(weights)]``. All sources share ``share``
   times the words of the corpus, none more than ``repeats`` times its own; the excess goes to the others by weight.
   The level at which it settles is found from one-row sums over a table of the sources, as often as a further source
   reaches its limit.
2. Blocks. Each source is a stream of its documents in the order of a hash, and a block is a stretch of about
   ``block_words`` words of it, whole documents. For each pass over the source its blocks are permuted anew; the
   mix takes them in that order up to the target, and cuts the last block, so a source gives its target to the word.
3. Shards. A source's quota is its number of drawn blocks. A tree halves the range of output shards again and again; at each
   node the left half's blocks are drawn without replacement from the node's, first among groups of sources and then
   among the sources of each group, which is the same law as shuffling all drawn blocks and cutting the row into shards. Every
   shard gets its number of blocks exactly, every source gives its quota exactly, and the counts tell which range of
   the permuted blocks belongs to which shard, so no block is drawn twice in a pass.
4. Inside a shard documents are ordered by a hash.

A task of the tree holds one node and one group of sources: at most ``FAN`` ranges times the square root of the number of sources.
Running sums go over hash buckets, so a hot source is spread over as many tasks as it has buckets. All
choices are hashes or seeded by the node, so a rerun or a recomputed task gives the same mix.

Defined results: null and empty texts have no words, count for no target and are never taken. Repeated rows are documents of their own, and
so are rows with a null id. A null source is a source, unlike an empty one. A source without words has target 0. An
empty table gives no rows. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.packing import running_before
from metricloom.llm.storage import partitions_for, stage

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS, FAN, SEED = 16_384, 64, 256, 11
#: Rows of a hash bucket in the running sums.
BUCKET_ROWS = 50_000
#: Blocks grow with the corpus beyond this number: hypergeometric draws take counts below 10**9.
MOST_BLOCKS = 400_000_000
WORD = r"[^ \t-\r]+"
NODES = "lo long, hi long, k string, n long, first long"


@dataclass
class Mixture:
    """The plan of a mix; all three tables are written.

    ``documents``: ``doc_id, source, size, at, block, k, place`` (and ``text`` if asked for). ``sources``: ``k, source, size, weight, target``.
    ``drawn``: ``k, block, epoch, base, room`` (how many words of the block are taken), ``shard``.
    """

    documents: DataFrame
    sources: DataFrame
    drawn: DataFrame
    shards: int
    seed: int

    def taken(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, taken`` of each row."""
        lists = self.drawn.groupBy("k", "block", "base").agg(F.collect_list("room").alias("rooms"))
        blocks = self.documents.select("k", "block").distinct().join(lists, ["k", "block"], "left")
        blocks = blocks.join(self.sources.select("k", F.col("size").alias("source_size"), "target"), "k")
        blocks = stage(blocks, "mixing-blocks")
        room = F.transform("rooms", lambda r: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), r - (F.col("at") - F.col("base")))))
        taken = F.coalesce(F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
        return self.documents.join(blocks, ["k", "block"]).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))

    def pieces(self) -> DataFrame:
        """``shard, position, doc_id, source, epoch, n_words`` (the first words of the document) of all that the mix takes; ``text`` if kept."""
        words = F.least(F.col("size"), F.col("room") - (F.col("at") - F.col("base")))
        rows = self.documents.filter("size > 0").join(self.drawn, ["k", "block"]).withColumn("n_words", words).filter("n_words > 0")
        order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed), "shard", "epoch", "place"), "place", "at", "epoch")
        rows = rows.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
        columns = ["shard", "position", "doc_id", "source", "epoch", "n_words"]
        if "text" in self.documents.columns:
            cut = F.array_join(F.slice(F.array_remove(F.split("text", r"[ \t-\r]+"), ""), F.lit(1), F.col("n_words").cast("int")), " ")
            rows = rows.withColumn("text", F.when(F.col("n_words") < F.col("size"), cut).otherwise(F.col("text")))
            columns.append("text")
        return rows.select(columns)

    def write(self, path: str) -> None:
        """One folder of ordered files; a shard lies in one file."""
        self.pieces().repartition(self.shards, "shard").sortWithinPartitions("shard", "position").write.parquet(path)


def source_targets(measured: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> tuple[DataFrame, int]:
    """The written table ``k, source, size, weight, target``, and the words of all sources."""
    sums = measured.groupBy("k", "source").agg(F.sum("size").alias("size"))
    # Numbered in order: each range of a distributed sort by itself, after the sizes of the ranges before.
    ordered = stage(sums.orderBy("k").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "mixing-sources")
    parts = ordered.groupBy("part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    number = ((F.col("before") + F.col("at") - F.col("least")) % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), number + 1)
    table = stage(ordered.join(parts, "part").select("k", "source", "size", weight.alias("weight")), "mixing-weights")
    limit = F.col("size") * repeats
    total = table.agg(F.sum("size")).first()[0] or 0
    level, known = 0.0, -1
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        found = table.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, limit)).alias("given"),
                          F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if found.n == known or not found.open:
            break
        known, level = found.n, max(level, (share * total - (found.given or 0)) / found.open)
    target = F.when(limit <= F.col("weight") * F.lit(level), limit.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return stage(table.withColumn("target", target), "mixing-targets"), total


def hypergeometric_split(counts: np.ndarray, capacities: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks each range gets (ranges by sources), drawn down a binary tree over the ranges."""
    if len(capacities) == 1:
        return counts[None, :]
    half = len(capacities) // 2
    left = rng.multivariate_hypergeometric(counts, int(capacities[:half].sum()), method="marginals")
    return np.concatenate([hypergeometric_split(left, capacities[:half], rng), hypergeometric_split(counts - left, capacities[half:], rng)])


def edges_of(lo: int, hi: int, fan: int) -> list[int]:
    """Where a node's range of shards is cut."""
    parts = min(fan, hi - lo)
    return [lo + (hi - lo) * i // parts for i in range(parts + 1)]


def shard_counts(quotas: DataFrame, shards: int, total: int, *, groups: int, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """``lo`` (the shard), ``k, n, first``: which range of its drawn blocks each source (``k, n``) gives to each shard.

    Shard ``i`` gets ``(i + 1) * total // shards - i * total // shards`` blocks.
    """

    def sizes(edges: list[int]) -> np.ndarray:
        return np.diff([e * total // shards for e in edges])

    def among_groups(rows: pa.Table) -> pa.Table:
        lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
        rows = rows.sort_by("g")
        edges = edges_of(lo, hi, fan)
        given = hypergeometric_split(rows["n"].to_numpy(), sizes(edges), np.random.default_rng([seed, lo, hi, 0]))
        r, c = np.indices(given.shape)
        return pa.table([pa.array(np.full(given.size, lo)), pa.array(np.full(given.size, hi)), rows["g"].combine_chunks().take(pa.array(c.ravel())),
                         pa.array(np.array(edges[:-1])[r.ravel()]), pa.array(np.array(edges[1:])[r.ravel()]), pa.array(given.ravel())],
                        names=["lo", "hi", "g", "sub_lo", "sub_hi", "capacity"])

    def among_sources(rows: pa.Table, ranges: pa.Table) -> pa.Table:
        rows, ranges = rows.sort_by("k").combine_chunks(), ranges.sort_by("sub_lo")
        lo, hi, g = (rows[c][0].as_py() for c in ("lo", "hi", "g"))
        given = hypergeometric_split(rows["n"].to_numpy(), ranges["capacity"].to_numpy(), np.random.default_rng([seed, lo, hi, 1 + g]))
        first = rows["first"].to_numpy()[None, :] + np.cumsum(given, axis=0) - given
        r, c = np.nonzero(given)
        return pa.table([ranges["sub_lo"].combine_chunks().take(pa.array(r)), ranges["sub_hi"].combine_chunks().take(pa.array(r)),
                         rows["k"].combine_chunks().take(pa.array(c)), pa.array(given[r, c]), pa.array(first[r, c])],
                        names=["lo", "hi", "k", "n", "first"])

    long = "long"
    nodes = quotas.select(F.lit(0).cast(long).alias("lo"), F.lit(shards).cast(long).alias("hi"), "k", F.col("n").cast(long), F.lit(0).cast(long).alias("first"))
    width = shards
    while width > 1:
        rows = nodes.withColumn("g", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int"))
        totals = rows.groupBy("lo", "hi", "g").agg(F.sum("n").alias("n"))
        ranges = totals.groupBy("lo", "hi").applyInArrow(
            among_groups, "lo long, hi long, g int, sub_lo long, sub_hi long, capacity long")
        keys = ["lo", "hi", "g"]
        nodes = stage(rows.groupBy(*keys).cogroup(ranges.groupBy(*keys)).applyInArrow(among_sources, NODES), "mixing-nodes")
        width = -(-width // fan)
    return nodes


def mixture(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
            share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
            seed: int = SEED, texts: bool = False) -> Mixture:
    """Plan the mix of all rows; ``texts`` keeps the texts beside it for ``pieces`` and ``write``."""
    if not 0 <= share <= repeats or min(weights) <= 0:
        raise ValueError("share must lie between 0 and repeats, weights above 0")
    spark = docs.sparkSession
    plain = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text", f"cast(`{source}` as string) source")
    measured = plain.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("place"),
        # Sorts as the source does, with null after all others.
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("k"), *["text"] * texts)
    measured = stage(measured, "mixing-measured")
    sources, total = source_targets(measured, weights, share, repeats)
    block_words = max(block_words, -(-total * repeats // MOST_BLOCKS))
    buckets = partitions_for(spark, measured.count(), BUCKET_ROWS)
    documents = stage(_streamed(measured, buckets, block_words), "mixing-documents")
    blocks = stage(documents.filter("size > 0").groupBy("k", "block").agg(F.sum("size").alias("words"), F.min("at").alias("base")), "mixing-blocks")
    drawn = stage(_drawn(blocks, sources, repeats, seed, partitions_for(spark, total / block_words, BUCKET_ROWS)), "mixing-drawn")
    quotas = stage(drawn.groupBy("k").agg(F.count("*").alias("n")), "mixing-quotas")
    n_sources, n_blocks = quotas.agg(F.count("*"), F.sum("n")).first()
    n_blocks = n_blocks or 0
    shards = max(1, -(-n_blocks // shard_blocks))
    counts = shard_counts(quotas, shards, n_blocks, groups=max(1, round(n_sources ** 0.5)), seed=seed)
    owners = counts.select("k", F.col("lo").alias("shard"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("number"))
    drawn = stage(drawn.join(owners, ["k", "number"]).drop("number"), "mixing-shards")
    return Mixture(documents, sources, drawn, shards, seed)


def hash_range(h: str, buckets: int) -> Column:
    """One of ``buckets`` ranges or more of a hash, in its order, so their number changes no result."""
    return F.shiftright(h, 64 - max(1, (buckets - 1).bit_length()))


def _streamed(measured: DataFrame, buckets: int, block_words: int) -> DataFrame:
    """Adds ``at``, the words of the source's stream before the document, and its ``block``."""
    rows = measured.withColumn("bucket", hash_range("place", buckets))
    sums = rows.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    held = running_before(sums, "bucket", "n", ("k",)).select("k", "bucket", F.col("before").alias("held"))
    inside = Window.partitionBy("k", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("ahead", F.sum("size").over(inside) - F.col("size")).join(held, ["k", "bucket"])
    placed = placed.withColumn("at", F.col("held") + F.col("ahead")).drop("held", "ahead", "bucket")
    # Empty documents have no place in the stream; they are spread over blocks of their own.
    block = F.when(F.col("size") > 0, F.floor(F.col("at") / F.lit(block_words))).otherwise(-1 - F.pmod("place", F.lit(1024)))
    return placed.withColumn("block", block.cast("long"))


def _drawn(blocks: DataFrame, sources: DataFrame, repeats: int, seed: int, buckets: int) -> DataFrame:
    """``k, block, epoch, base, room, number``: the blocks that the mix takes, numbered within their source."""
    own = blocks.groupBy("k").agg(F.count("*").alias("blocks"))
    quota = F.floor(F.col("target") + 0.5).cast("long")
    each = sources.filter("size > 0").join(own, "k").select("k", "blocks", F.col("size").alias("s"), quota.alias("quota"))
    rows = blocks.join(each, "k").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    left = F.least(F.col("s"), F.col("quota") - F.col("epoch") * F.col("s"))
    rows = rows.withColumn("left", left).filter("left > 0").withColumn("h", F.xxhash64(F.lit(seed), "epoch", "k", "block"))
    rows = rows.withColumn("bucket", hash_range("h", buckets))
    by = ["k", "epoch", "bucket"]
    sums = rows.groupBy(*by).agg(F.sum("words").alias("w"), F.count("*").alias("c"))
    held = running_before(sums, "bucket", "w", ("k", "epoch")).withColumnRenamed("before", "held_words")
    held = running_before(held, "bucket", "c", ("k", "epoch")).withColumnRenamed("before", "held_blocks").drop("w", "c")
    inside = Window.partitionBy(*by).orderBy("h", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"words_in": F.sum("words").over(inside) - F.col("words"), "blocks_in": F.count("*").over(inside) - 1})
    rows = rows.join(held, by).withColumn("room", F.least(F.col("words"), F.col("left") - F.col("held_words") - F.col("words_in")))
    number = F.col("epoch") * F.col("blocks") + F.col("held_blocks") + F.col("blocks_in")
    return rows.filter("room > 0").select("k", "block", "epoch", "base", "room", number.alias("number"))


def brute_force(rows: list[tuple], *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
                block_words: int = BLOCK_WORDS, seed: int = SEED) -> list[tuple]:
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source), step by step in one list; for tests."""
    import re

    import xxhash

    def h64(*values) -> int:
        acc = 42
        for v in values:
            if v is not None:
                # Small numbers given as (value, bytes).
                data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
                acc = xxhash.xxh64_intdigest(data, acc)
        return acc - 2**64 if acc >= 2**63 else acc

    docs = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), h64((seed, 4), d, t), "1" if s is None else "0" + s) for d, t, s in rows]
    size: dict[str, int] = {}
    for _, n, _, k in docs:
        size[k] = size.get(k, 0) + n
    weight = {k: weights[i % len(weights)] for i, k in enumerate(sorted(size))}
    goal, full = share * sum(size.values()), {}
    while open_ := [k for k in size if k not in full]:
        rest, w = goal - sum(full.values()), sum(weight[k] for k in open_)
        above = [k for k in open_ if rest * weight[k] / w >= repeats * size[k]]
        if not above:
            break
        full.update({k: float(repeats * size[k]) for k in above})
    target = {k: full[k] if k in full else rest * weight[k] / w for k in size}
    taken = {}
    for k in size:
        own = sorted((i for i in range(len(docs)) if docs[i][3] == k and docs[i][1]), key=lambda i: (docs[i][2], docs[i][0] is not None, docs[i][0] or 0))
        blocks: dict[int, list[int]] = {}
        at = 0
        for i in own:
            blocks.setdefault(at // block_words, []).append(i)
            at += docs[i][1]
        left = int(target[k] + 0.5)
        for epoch in range(repeats):
            for b in sorted(blocks, key=lambda b: (h64((seed, 4), (epoch, 4), k, b), b)):
                for i in blocks[b]:
                    got = min(left, docs[i][1])
                    taken[i], left = taken.get(i, 0) + got, left - got
    return [(d, n, size[k], target[k], taken.get(i, 0)) for i, (d, n, _, k) in enumerate(docs)]
