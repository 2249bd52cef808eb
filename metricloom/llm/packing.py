"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length.

All ids form one stream that is cut every ``seq_len`` ids, so only its last sequence
has padding. The order of the stream is what the mixture controls:

1. Texts are encoded once and written to a table. Each source's documents form one queue
   over the whole table, ordered by a hash of the document; running sums give the ids of
   the queue that lie before each document.
2. The whole stream follows the target shares until a source is used up; then the others
   take its share in proportion. So there is a time at which each stretch of about
   ``bucket_tokens`` ids ends, and what a source has given by then is its rate times that
   time, as far as it goes. This is what one queue server would have served, so nothing
   is owed from one stretch to the next beyond a fraction of an id.
3. Documents are cut where a stretch of their source's queue ends and go to the task of
   that stretch. It serves its queues in windows of ``window_sequences`` sequences. In a
   window every source gets its share of the ids plus its deficit; documents are cut
   where the share ends. A source whose queue is empty keeps its deficit, and the others
   fill the window.

Target shares are those of the corpus unless given, so no source runs out early. With
given shares all documents are still packed. Sources without a target come after the
others, in proportion to their size. One row for each source is held by the driver.

Defined results: null text is a document of the end id alone; null sources are one
source. Repeated rows and null ids are packed row by row. An empty table gives no
pieces. Other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.encoding import text_encoder
from metricloom.llm.storage import partitions_for, stage
from metricloom.llm.token_files import documents_ids, id_width
from metricloom.llm.words import as_array, slices

SEQUENCE = 2048
WINDOW_SEQUENCES = 32
BUCKET_TOKENS = 2 << 20
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
CUT = pa.schema([(c, pa.int64()) for c in ("stretch",)] + [("source", pa.string())] + [
    (c, pa.int64()) for c in ("at", "doc_id", "start", "n", "n_tokens")] + [("ids", pa.binary())])
#: Hash buckets in a group of the two-level running sums.
COARSE = 1024


class Stream:
    """How far each source's queue has been served at the ends of ``stretches`` stretches of the stream."""

    def __init__(self, held: Mapping[str, int], targets: Mapping[str, float] | None, stretches: int):
        sources = sorted(held)
        size = np.array([held[s] for s in sources], np.float64)
        rate = size.copy() if targets is None else np.array([float(targets.get(s, 0.0)) for s in sources])
        if not (rate >= 0).all() or not np.isfinite(rate).all():
            raise ValueError("targets must be finite numbers of 0 or more")
        aimed = rate > 0
        rate[aimed] /= rate[aimed].sum()
        # Time is in ids while no source is used up. Those without a target start when all others are.
        start = np.where(aimed, 0.0, (size[aimed] / rate[aimed]).max(initial=0.0))
        rate[~aimed] = size[~aimed] / max(size[~aimed].sum(), 1.0)
        # A weight beside those of the aimed sources: next to nothing until they are used up.
        self.weight = dict(zip(sources, np.where(aimed, rate, 1e-9 * rate).tolist(), strict=True))
        self.of = {s: x for s, *x in zip(sources, size.tolist(), rate.tolist(), start.tolist(), strict=True)}
        corners = np.unique(np.concatenate([[0.0], start, start + size / rate]))
        served = np.zeros(len(corners))
        for n, r, v in self.of.values():
            served += np.clip(r * (corners - v), 0.0, n)
        self.times = np.interp(np.linspace(0.0, size.sum(), stretches + 1), served, corners)
        self.begins = sum(self.ends_of(s) for s in sources)

    def ends_of(self, source: str) -> np.ndarray:
        """The ids of ``source`` that lie before each stretch, and at last all of them."""
        n, r, v = self.of[source]
        ends = np.floor(np.clip(r * (self.times - v), 0.0, n)).astype(np.int64)
        ends[-1] = int(n)
        return np.maximum.accumulate(ends)


def encoded_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1) -> DataFrame:
    """``doc_id, source, place, n_tokens, ids`` of each row; ids little-endian, the end id included."""
    width = id_width(tokenizer_path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        for batch in batches:
            for a, b in slices(as_array(batch.column(3))):
                part = batch.slice(a, b - a)
                ids, ends = documents_ids(encoder, part.column(3), end_id, width)
                data = ids.tobytes()
                at = (ends * width).tolist()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(np.diff(ends), pa.int64()),
                    pa.array([data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                ], ["doc_id", "source", "place", "n_tokens", "ids"])

    return docs.mapInArrow(encode, "doc_id long, source string, place long, n_tokens long, ids binary")


def running_before(df: DataFrame, key: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of smaller ``key`` with the same ``by``.

    Two levels, so no task orders more than ``COARSE`` rows or one row for each ``COARSE`` keys.
    """
    coarse = F.floor(F.col(key) / COARSE).alias("_coarse")
    sums = df.groupBy(*by, coarse).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*by, "_coarse", (F.sum("_sum").over(Window.partitionBy(*by).orderBy("_coarse")) - F.col("_sum")).alias("_b"))
    inner = Window.partitionBy(*by, "_coarse").orderBy(key)
    fine = df.withColumn("_coarse", coarse).withColumn("_f", F.sum(value).over(inner) - F.col(value))
    return fine.join(sums, [*by, "_coarse"]).withColumn("before", F.col("_b") + F.col("_f")).drop("_coarse", "_b", "_f")


def allot(size: int, owed: np.ndarray, share: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How many of ``size`` ids each queue gives: what it is owed as far as it has it, the rest by share.

    ``owed`` holds share times size plus the deficit. Whole numbers that sum to ``size``
    (``left`` must hold that many).
    """
    take = np.minimum(np.maximum(np.floor(owed), 0), left).astype(np.int64)
    over = int(take.sum()) - size
    if over > 0:
        # Deficits of several queues fall due together: all wait in proportion.
        scaled = np.floor(take * (size / take.sum())).astype(np.int64)
        take = scaled
    short = size - int(take.sum())
    while short > 0:
        room = left - take
        open_ = room > 0
        weight = np.where(open_, np.maximum(share, 1e-12), 0.0)
        more = np.minimum(np.floor(short * weight / weight.sum()).astype(np.int64), room)
        if not more.any():
            # Single ids, to the queues most in arrears.
            at = np.flatnonzero(open_)
            at = at[np.argsort(-(owed - take)[at], kind="stable")][:short]
            more = np.zeros(len(take), np.int64)
            more[at] = 1
        take = take + more
        short = size - int(take.sum())
    return take


def serve(queues: list[list[int]], share: np.ndarray, deficit: np.ndarray, begin: int,
          window: int) -> Iterator[tuple[int, int, int]]:
    """(source, document, ids taken) in stream order from queues of document lengths; windows end at multiples of ``window``."""
    left = np.array([sum(q) for q in queues], np.int64)
    place, used = [0] * len(queues), [0] * len(queues)
    at, end = begin, begin + int(left.sum())
    while at < end:
        size = min(window - at % window, end - at)
        take = allot(size, share * size + deficit, share, left)
        deficit = deficit + share * size - take
        left = left - take
        for s in np.flatnonzero(take).tolist():
            need = int(take[s])
            while need:
                length = queues[s][place[s]] - used[s]
                got = min(need, length)
                yield s, place[s], got
                need -= got
                used[s] += got
                if got == length:
                    place[s], used[s] = place[s] + 1, 0
        at += size


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         seq_len: int = SEQUENCE, end_id: int = 1, window_sequences: int = WINDOW_SEQUENCES,
         bucket_tokens: int = BUCKET_TOKENS, targets: Mapping[str, float] | None = None) -> DataFrame:
    """One row for each piece: which ids of which document lie where in which sequence."""
    spark = docs.sparkSession
    place = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))
    plain = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"coalesce(cast(`{source}` as string), '') source",
                            f"cast(`{text}` as string) text")
    encoded = stage(encoded_documents(plain.select("doc_id", "source", place.alias("place"), "text"), tokenizer_path,
                                      end_id=end_id), "packing-ids")
    width = id_width(tokenizer_path, end_id)
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = partitions_for(spark, total, bucket_tokens)
    encoded = encoded.withColumn("bucket", F.pmod("place", F.lit(buckets)))
    sums = encoded.groupBy("bucket", "source").agg(F.sum("n_tokens").alias("n"))
    sources = {r.source: r.n for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if not sources:
        return spark.createDataFrame([], PIECES)
    stream = Stream(sources, targets, buckets)
    held = running_before(sums, "bucket", "n", ("source",)).select("bucket", "source", F.col("before").alias("held"))
    # Queue places: rows of a hash bucket in order, after the smaller buckets of the same source.
    queue = Window.partitionBy("bucket", "source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = encoded.repartition(buckets, "bucket", "source").withColumn("ahead", F.sum("n_tokens").over(queue) - F.col("n_tokens"))
    placed = placed.join(held.repartition(buckets, "bucket", "source"), ["bucket", "source"]).select(
        "doc_id", "source", (F.col("held") + F.col("ahead")).alias("at"), "n_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[str, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            for d, s, at, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s not in ends:
                    ends[s] = stream.ends_of(s)
                b, done = int(np.searchsorted(ends[s], at, "right")) - 1, 0
                while done < n:
                    got = min(n - done, int(ends[s][b + 1]) - at - done)
                    if got:
                        out.append((b, s, at + done, d, done, got, n, data[done * width:(done + got) * width]))
                    done, b = done + got, b + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CUT.types, strict=True)], schema=CUT)

    stretches = placed.mapInArrow(cut, "stretch long, source string, at long, doc_id long, start long, n long, n_tokens long, ids binary")
    window = window_sequences * seq_len

    def serve_stretch(left: pa.Table) -> pa.Table:
        names = sorted(set(left["source"].to_pylist()))
        number = {s: i for i, s in enumerate(names)}
        rows: list[list[int]] = [[] for _ in names]
        sources, counts = left["source"].to_pylist(), left["n"].to_pylist()
        for i in np.argsort(left["at"].to_numpy(), kind="stable").tolist():
            rows[number[sources[i]]].append(i)
        queues = [[counts[i] for i in q] for q in rows]
        ids, doc_ids = left["ids"].to_pylist(), left["doc_id"].to_pylist()
        starts, lengths = left["start"].to_pylist(), left["n_tokens"].to_pylist()
        share = np.array([stream.weight[s] for s in names])
        at = int(stream.begins[left["stretch"][0].as_py()])
        done = [0] * left.num_rows
        out: list[tuple] = []
        wide: dict[int, bytes] = {}
        for s, k, n in serve(queues, share / share.sum(), np.zeros(len(names)), at, window):
            i = rows[s][k]
            if i not in wide:
                wide[i] = np.frombuffer(ids[i], f"<u{width}").astype("<u4").tobytes()
            while n:
                got = min(n, seq_len - at % seq_len)
                a = done[i]
                out.append((doc_ids[i], starts[i] + a, got, zlib.crc32(wide[i][4 * a:4 * (a + got)]), lengths[i], at // seq_len,
                            at % seq_len, names[s]))
                done[i], at, n = a + got, at + got, n - got
            if done[i] == counts[i]:
                del wide[i]
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.string())],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return stretches.repartition(buckets, "stretch").groupBy("stretch").applyInArrow(serve_stretch, PIECES)
