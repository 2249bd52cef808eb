"""Maximal repeated line runs by prefix doubling over line sequences; later copies are deleted.

A line goes if it lies in a run of ``min_lines`` lines or more, with a word in it, that a
document with a smaller id has too, or the same document earlier on. By default one line
is a run.

1. Lines that occur once end every run. The others stay, apart from lines without words
   that no repeated line with a word is next to. Lines that always follow one another, everywhere they occur, are
   one block: a maximal run holds such a block whole or not at all. A copied document without other
   repeats is one block, however long it is.
2. Prefix doubling: a place is named at level j by the 2**j blocks that begin there, a name being
   made of those of the two halves.
3. The intervals of the suffixes' longest common prefixes, found from the longest level down. An interval
   of common blocks is split at level j by the names at the places behind them. Where two suffixes or more agree, they make
   an interval that is 2**j blocks longer; its first place stays behind and stands for it, so that a shorter
   prefix is found too. No interval is gathered anywhere: splitting one is a partial aggregation and a join with the
   names that occur twice. There are no more rows than places and intervals.
4. In each interval every place but the first has an earlier copy of that length, and it stays behind only as a first place, so
   the length where it ceases to be first is that of its longest earlier copy. Runs inside longer runs are not maximal; the others are
   ``maximal_runs``, and their lines go.

Names are hashes of 96 bits in place of ranks: the intervals are the same, in no order.
Only DataFrame functions run here.

Defined results: lines are what ``\\n`` separates, compared as they are. Null texts stay
null and have no lines. Rows with a null id lose only copies within themselves. Rows of
the same id and different text do not affect each other; repeated rows have the same
result each. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.storage import drop_tables, stage, tables_made

MIN_LINES = 1
RUNS = "doc_id long, t long, start int, length int, first_doc_id long, first_start int, new_from int"


def next_and_last_words(lines: DataFrame) -> DataFrame:
    """Adds ``next`` and ``last``: the next line with a word from each line on, and the last one up to it (null or -1 beyond)."""
    wordy = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(r"[^ \t-\r]"), i)), lambda i: i.isNotNull())
    table = lines.withColumn("words", wordy).withColumn("n_words", F.size("words"))
    numbers = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1)).otherwise(F.array().cast("array<int>"))

    def word(k: Column, none: Column) -> Column:
        return F.coalesce(F.get("words", k), none)

    table = table.withColumn("next", F.flatten(F.transform(
        numbers, lambda k: F.array_repeat(F.get("words", k), F.get("words", k) - word(k - 1, F.lit(-1))))))
    return table.withColumn("last", F.concat(
        F.array_repeat(F.lit(-1), word(F.lit(0), F.size("lines"))),
        F.flatten(F.transform(numbers, lambda k: F.array_repeat(
            F.get("words", k), word(k + 1, F.size("lines")) - F.get("words", k)))))).drop("words", "n_words")


def line_places(docs: DataFrame) -> DataFrame:
    """A row for each line: its name, those beside it, and how far the next and the last line with a word are."""
    lines = docs.filter("text is not null").select("doc_id", "t", F.split("text", "\n").alias("lines"))
    # Rows without an id have lines of their own.
    own = F.when(F.col("doc_id").isNull(), F.col("t"))

    def beside(i: Column) -> Column:
        return F.when(F.get("lines", i).isNotNull(), F.xxhash64(F.get("lines", i), own))

    each = F.transform("lines", lambda x, i: F.struct(
        i.alias("i"), F.xxhash64(x, own).alias("a"), F.hash(x, own).alias("b"), (F.get("next", i) - i).alias("w"),
        F.when(F.get("last", i) >= 0, i - F.get("last", i)).alias("v"), beside(i - 1).alias("before"), beside(i + 1).alias("after")))
    return next_and_last_words(lines).select("doc_id", "t", F.inline(each))


def _always(column: str) -> Column:
    """Whether a line has the same one on this side wherever it occurs."""
    return (F.count(column) == F.count("*")) & (F.min(column) == F.max(column))


def repeated_sequences(docs: DataFrame) -> DataFrame:
    """``doc_id, t, s``: the blocks (first line ``i``, ``n`` lines, a, b, w) of a document that can be part of a repeated run."""
    places = stage(line_places(docs), "line-places")
    repeats = places.groupBy("a", "b").agg(
        F.count("*").alias("n"), _always("before").alias("led"), _always("after").alias("followed")).filter("n > 1").drop("n")
    held = places.join(stage(repeats, "line-repeats"), ["a", "b"]).groupBy("doc_id", "t").agg(
        F.sort_array(F.collect_set(F.struct("i", "a", "b", "w", "v", "led", "followed"))).alias("all"))

    def beside_words(x: Column, k: Column) -> Column:
        after, before = F.get("all", k + x["w"])["i"] == x["i"] + x["w"], F.get("all", k - x["v"])["i"] == x["i"] - x["v"]
        return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

    def begins(x: Column, k: Column) -> Column:
        last = F.get("lines", k - 1)
        return F.when(F.coalesce((last["i"] == x["i"] - 1) & last["followed"] & x["led"], F.lit(False)), None).otherwise(k)

    def block(k: Column, h: Column) -> Column:
        x, end = F.get("lines", k), F.coalesce(F.get("heads", h + 1), F.size("lines"))
        return F.struct(x["i"].alias("i"), (end - k).alias("n"), x["a"].alias("a"), x["b"].alias("b"), x["w"].alias("w"))

    table = held.select("doc_id", "t", F.filter("all", beside_words).alias("lines"))
    table = table.withColumn("heads", F.filter(F.transform("lines", begins), lambda k: k.isNotNull()))
    return table.select("doc_id", "t", F.transform("heads", block).alias("s"))


def _doubled(j: int):
    """The names at level ``j + 1`` from those at level ``j``; null where the blocks do not follow one another."""
    half = 1 << j

    def name(x: Column, k: Column) -> Column:
        y = F.get(f"level{j}", k + half)
        whole = x.isNotNull() & y.isNotNull() & (F.get("s", k + half)["i"] - F.get("s", k)["i"] == x["n"])
        return F.when(whole, F.struct(F.xxhash64(x["a"], y["a"], x["b"]).alias("a"), F.hash(x["b"], y["b"], y["a"]).alias("b"),
                                      (x["n"] + y["n"]).alias("n")))

    return name


def named_places(sequences: DataFrame, levels: int) -> DataFrame:
    """``doc_id, t, i, w, names``: names and lines of the 1, 2, 4 ... blocks from each place on, as far as blocks follow one another."""
    table = sequences.withColumn("level0", F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["n"].alias("n"))))
    for j in range(levels - 1):
        table = table.withColumn(f"level{j + 1}", F.transform(f"level{j}", _doubled(j)))

    def place(x: Column, k: Column) -> Column:
        names = F.array(*[F.get(f"level{j}", k) for j in range(levels)])
        return F.struct(x["i"].alias("i"), x["w"].alias("w"), F.filter(names, lambda n: n.isNotNull()).alias("names"))

    return table.select("doc_id", "t", F.inline(F.transform("s", place)))


def split_intervals(rows: DataFrame, places: DataFrame, level: int) -> DataFrame:
    """The rows of all intervals (``g1, g2`` of ``c`` lines) after those that agree in ``2 ** level`` more blocks moved on.

    ``u`` tells apart what an interval holds: places, and intervals that it stands for. ``names`` are those at the place
    ``c`` lines on, below ``level`` afterwards.
    """
    keys = ["g1", "g2", "ka", "kb"]
    name = F.get("names", F.lit(level))
    rows = rows.withColumn("ka", name["a"]).withColumn("kb", name["b"])
    found = rows.filter("ka is not null").groupBy(*keys).agg(
        F.min("u").alias("lo"), F.max("u").alias("hi"), F.min("doc_id").alias("first")).filter("lo < hi")
    found = stage(found.select(*keys, "first", F.xxhash64(*keys, F.lit(level)).alias("n1"),
                               F.hash(*reversed(keys), F.lit(level)).alias("n2")), "line-intervals")
    moves, shorter = F.col("n1").isNotNull(), F.slice("names", 1, level)
    on = F.when(moves, F.col("c") + name["n"]).otherwise(F.col("c"))
    new = rows.join(found, keys, "left").select(
        F.coalesce("n1", "g1").alias("g1"), F.coalesce("n2", "g2").alias("g2"), on.alias("c"), "doc_id", "t", "i", "w", "u",
        F.when(~moves, shorter).alias("names"))
    none = F.array().cast("array<struct<a:bigint,b:int,n:int>>")
    if level:
        ahead = places.filter(F.size("names") > 0).select(
            F.col("doc_id").alias("d2"), F.col("t").alias("t2"), F.col("i").alias("i2"), shorter.alias("ahead"))
        at = F.when(F.col("names").isNull(), F.col("i") + F.col("c"))
        new = new.withColumn("at", at).join(
            ahead, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")) & (F.col("at") == F.col("i2")), "left")
        new = new.withColumn("names", F.coalesce("names", "ahead", none)).drop("at", "d2", "t2", "i2", "ahead")
    else:
        new = new.withColumn("names", none)
    # The first place stands for the new interval; rows of one id that differ do not affect each other, so each has one.
    first = rows.join(found, keys).filter(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy(*keys, "doc_id", "t", "c", "n1").agg(
        F.min(F.struct("i", "w")).alias("p"), F.any_value("names").alias("names"))
    stand = first.select("g1", "g2", "c", "doc_id", "t", "p.i", "p.w", F.col("n1").alias("u"), shorter.alias("names"))
    return new.unionByName(stand).filter("c > 0 or size(names) > 0")


def common_prefixes(places: DataFrame, levels: int) -> DataFrame:
    """``g1, g2, c, doc_id, t, i, w``: the suffixes in each interval of ``c`` common lines, a first place for each one inside it."""
    spark, state = places.sparkSession, None
    with tables_made() as made:
        for level in reversed(range(levels)):
            whole = places.filter(F.size("names") == level + 1).select(
                F.lit(0).cast("long").alias("g1"), F.lit(0).alias("g2"), F.lit(0).alias("c"), "doc_id", "t", "i", "w",
                F.xxhash64("doc_id", "t", "i").alias("u"), "names")
            rows = whole if state is None else state.unionByName(whole)
            state = stage(split_intervals(rows, places, level), "line-prefixes")
            made[:] = drop_tables(spark, made, state)
    return state.drop("u", "names")


def maximal_runs(docs: DataFrame, *, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, t, start, length, first_doc_id, first_start, new_from``: maximal runs that are later copies.

    The first copy is the one in the smallest document, or the first one in the same document where no smaller one has the run.
    Runs may overlap; lines from ``new_from`` on are in no run that begins earlier. ``docs`` has the columns
    ``doc_id, t, text``; ``t`` tells apart rows of one id.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    spark = docs.sparkSession
    sequences = stage(repeated_sequences(docs), "line-sequences")
    longest = sequences.agg(F.max(F.size("s"))).first()[0]
    if not longest:
        return spark.createDataFrame([], RUNS)
    places = stage(named_places(sequences, longest.bit_length()), "line-names")
    state = common_prefixes(places, places.agg(F.max(F.size("names"))).first()[0])
    # One row for each document in an interval.
    held = stage(state.filter(F.col("c") >= min_lines).groupBy("g1", "g2", "c", "doc_id", "t").agg(
        F.sort_array(F.collect_set(F.struct("i", "w"))).alias("places")), "line-classes")
    firsts = held.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", F.get("places", F.lit(0))["i"].alias("i"))).alias("first"),
                                          F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = stage(firsts, "line-firsts")
    across = held.join(firsts, ["g1", "g2"]).filter("doc_id > first.doc_id").select("c", "doc_id", "t", "places", "first")
    # The first place of a run in its own document is an original unless an earlier document has it.
    within = held.filter(F.size("places") > 1).select(
        "c", "doc_id", "t", F.slice("places", F.lit(2), F.size("places")).alias("places"),
        F.struct("doc_id", F.get("places", F.lit(0))["i"].alias("i")).alias("first"))
    copies = across.union(within).select("doc_id", "t", "c", "first", F.inline("places")).filter(F.col("w") < F.col("c"))
    before = Window.partitionBy("doc_id", "t").orderBy("i", F.desc("c"), "first").rowsBetween(Window.unboundedPreceding, -1)
    ends = copies.withColumn("end", F.col("i") + F.col("c")).withColumn("reached", F.max("end").over(before))
    return ends.filter("reached is null or end > reached").select(
        "doc_id", "t", F.col("i").alias("start"), F.col("c").alias("length"), F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.i").alias("first_start"), F.greatest("i", "reached").alias("new_from"))


def later_copies(docs: DataFrame, *, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, t`` and ``gone`` (the numbers of the lines to delete) of documents that lose some."""
    runs = maximal_runs(docs, min_lines=min_lines)
    fresh = F.sequence(F.col("new_from"), F.col("start") + F.col("length") - 1)
    return runs.groupBy("doc_id", "t").agg(F.sort_array(F.flatten(F.collect_list(fresh))).alias("gone"))


def with_lines_removed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with its own columns, ``text`` without later copies, and ``_gone``, the deleted line numbers (null if none)."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    d, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    plain = inner.select(F.col(d).cast("long").alias("doc_id"), F.xxhash64(t).alias("t"), F.col(t).alias("text"))
    gone = later_copies(plain, min_lines=min_lines).withColumnRenamed("t", "_t")
    joined = inner.join(gone, F.col(d).eqNullSafe(F.col("doc_id")) & (F.xxhash64(t) == F.col("_t")), "left")
    lines = F.split(t, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = joined.withColumn("_lines", lines).withColumn("_kept", F.when(F.size("gone") > 0, kept))
    new = F.when(F.col("_kept").isNotNull() & (F.size("_lines") > 0),
                 F.array_join(F.transform("_kept", lambda i: F.get(F.col("_lines"), i)), "\n")).otherwise(F.col(t))
    return left.select(*[(new if c == t else F.col(c)).alias(n) for c, n in
                         zip([f"c{i}" for i in range(len(names))], names, strict=True)],
                       F.when(F.size("gone") > 0, F.col("gone")).alias("_gone"))


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of each row; a null text has no lines and the hash of no bytes."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    plain = plain.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    out = with_lines_removed(plain, min_lines=min_lines)
    return out.select(
        "doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed_raw"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    ).select("doc_id", "n_lines", F.greatest("n_removed_raw", F.lit(0)).cast("long").alias("n_removed"), "kept_sha256")


def remove_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with later copies of line runs deleted; documents that lose their last word go.

    The rebuilt texts are written before they are judged: a filter on them would be moved
    below the projections and split a text again for each of its lines.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rebuilt = stage(with_lines_removed(inner, doc_id=f"c{names.index(doc_id)}", text=f"c{names.index(text)}", min_lines=min_lines),
                    "lines-removed")
    stays = F.col("_gone").isNull() | F.col(f"c{names.index(text)}").rlike(r"[^ \t-\r]")
    return rebuilt.filter(stays).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def brute_kept(rows: list[tuple[int | None, str | None]], min_lines: int = MIN_LINES) -> list[tuple]:
    """(doc_id, n_lines, n_removed, kept text) by the definition; for tests."""
    docs = [(d, None if t is None else t.split("\n")) for d, t in rows]
    gone: list[set[int]] = [set() for _ in docs]
    places = [(n, i) for n, (_, lines) in enumerate(docs) for i in range(len(lines or []))]
    length = 1
    while places:
        # Only what is copied can be part of a longer copy; a run's original stays in, since it may go on.
        held: dict[tuple, list[tuple[int, int]]] = {}
        for n, i in places:
            if i + length <= len(docs[n][1]):
                held.setdefault(tuple(docs[n][1][i:i + length]), []).append((n, i))
        places = []
        for key, found in held.items():
            if len(found) < 2:
                continue
            places += found
            if length < min_lines or not any(x.strip("\x20\t\n\x0b\x0c\r") for x in key):
                continue
            ids = [docs[n][0] for n, _ in found if docs[n][0] is not None]
            own = {n: i for n, i in sorted(found, reverse=True)}
            for n, i in found:
                if own[n] < i or docs[n][0] is not None and min(ids) < docs[n][0]:
                    gone[n].update(range(i, i + length))
        length += 1
    out = []
    for (d, lines), gone_here in zip(docs, gone, strict=True):
        lines = lines or []
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone_here)
        out.append((d, len(lines), len(gone_here), kept))
    return out


def brute_force(rows: list[tuple[int | None, str | None]], min_lines: int = MIN_LINES) -> list[tuple]:
    """(doc_id, n_lines, n_removed, kept_sha256) by the definition; for tests."""
    import hashlib

    return [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute_kept(rows, min_lines)]
