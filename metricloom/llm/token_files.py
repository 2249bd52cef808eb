"""Token-id files: each document compressed by itself with one shared trained dictionary.

A file set is a Parquet folder of blocks, in ascending order of document id. A block
holds up to ``block_tokens`` ids of whole documents:

* ``data``: one zstandard frame for each document over its ids, little-endian and
  unsigned, ``id_bytes`` wide, the end id included;
* ``doc_ids``, ``n_tokens`` and ``ends``: the index, the last one telling where each
  frame ends in ``data``, so one document is read by decompressing its frame alone;
* ``first_doc_id`` and ``last_doc_id``: the block's range, by whose statistics a reader skips files and row groups;
* ``dictionary_hash``: names the dictionary, kept once in the folder ``dictionary``.

The dictionary is trained on stretches of ``SAMPLE_BYTES`` of ids of at most
``SAMPLE_DOCUMENTS`` different texts, chosen by a hash of the text; it changes sizes, never
contents.

Defined results: null text is empty, so a document of the end id alone. Null ids come
first. Rows that share an id follow one another in the order of their text and each
keeps its own ids. Other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.llm.encoding import text_encoder
from metricloom.llm.storage import partitions_for
from metricloom.llm.words import as_array, slices

SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16_384, 64 << 10
BLOCK_TOKENS = 1 << 20
LEVEL = 3
#: Documents of a shard; a shard's texts pass through one task, block by block.
SHARD_DOCUMENTS = 8192
BLOCKS = ("shard int, block int, first_doc_id long, last_doc_id long, dictionary_hash string, id_bytes int, "
          "doc_ids array<long>, n_tokens array<long>, ends array<long>, data binary")


def id_width(tokenizer_path: str, end_id: int) -> int:
    return 2 if max(text_encoder(tokenizer_path).tokenizer.get_vocab_size(True) - 1, end_id) < 1 << 16 else 4


def documents_ids(encoder, texts: pa.Array, end_id: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with each document's end id, in the file's width, and where documents end."""
    ids, ends = encoder.encode(texts)
    return np.insert(ids, ends[1:], end_id).astype(f"<u{width}"), ends + np.arange(len(ends))


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[str, bytes]:
    """Hash and bytes of a dictionary from a bounded sample of serialized id arrays; empty where the sample is too small.

    The sample is of different texts, so a large group of copies takes one place, and of each text one stretch
    that begins where the text's hash says. Stretches are cut in the tasks: no whole text reaches the driver.
    """
    width = id_width(tokenizer_path, end_id)
    texts = docs.filter(F.length("text") > 0).select(F.xxhash64("text").alias("h"), "text")
    chosen = texts.select("h").distinct().orderBy("h").limit(SAMPLE_DOCUMENTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        for batch in batches:
            for a, b in slices(as_array(batch.column(1))):
                ids, ends = documents_ids(encoder, as_array(batch.column(1)).slice(a, b - a), end_id, width)
                hashes = batch.column(0).slice(a, b - a).to_pylist()
                out = []
                for h, x, y in zip(hashes, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    at = x + h % max(1, y - x - SAMPLE_BYTES // width + 1)
                    out.append(ids[at:min(y, at + SAMPLE_BYTES // width)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(out, pa.binary())], ["h", "sample"])

    # At most SAMPLE_DOCUMENTS hashes are broadcast, and as many stretches of SAMPLE_BYTES come back.
    rows = texts.join(F.broadcast(chosen), "h").mapInArrow(cut, "h long, sample binary")
    samples = rows.groupBy("h").agg(F.min("sample").alias("sample")).orderBy("h").limit(SAMPLE_DOCUMENTS).toArrow()["sample"].to_pylist()
    try:
        data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        data = b""
    return hashlib.sha256(data).hexdigest(), data


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text",
                      end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text and write the file set below ``path``. One shuffle: texts by ranges of document ids."""
    spark = docs.sparkSession
    plain = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")
    digest, dictionary = train_dictionary(plain, tokenizer_path, end_id)
    width = id_width(tokenizer_path, end_id)
    spark.createDataFrame([(digest, dictionary)], "dictionary_hash string, data binary").coalesce(1).write.parquet(
        f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = text_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        held: list = []
        for batch in batches:
            for a, b in slices(as_array(batch.column(1))):
                names = batch.column(0).slice(a, b - a).to_pylist()
                ids, ends = documents_ids(encoder, batch.column(1).slice(a, b - a), end_id, width)
                for name, x, y in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if held and held[-1][3] + y - x > block_tokens:
                        yield _block(held, shard, number, digest, width)
                        held, number = [], number + 1
                    before = held[-1][3] if held else 0
                    held.append((name, y - x, compressor.compress(ids[x:y].tobytes()), before + y - x))
        if held:
            yield _block(held, shard, number, digest, width)

    shards = partitions_for(spark, docs.count(), SHARD_DOCUMENTS)
    ordered = plain.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _block(held: list, shard: int, number: int, digest: str, width: int) -> pa.RecordBatch:
    names, counts, frames, _ = zip(*held, strict=True)
    many = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([names[0]], pa.int64()), pa.array([names[-1]], pa.int64()), pa.array([digest]),
        pa.array([width], pa.int32()), pa.array([list(names)], many), pa.array([list(counts)], many),
        pa.array([np.cumsum([len(f) for f in frames]).tolist()], many), pa.array([b"".join(frames)], pa.binary()),
    ], ["shard", "block", "first_doc_id", "last_doc_id", "dictionary_hash", "id_bytes", "doc_ids", "n_tokens", "ends", "data"])


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    digest, data = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary of {path} does not match its hash")
    return bytes(data)


@functools.lru_cache(maxsize=2)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


def read_token_files(spark: SparkSession, path: str, *, checksums: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the ids (or their crc32) of each document.

    ``start`` counts the ids of all documents before. It is the sum over the shards
    before (a row for each shard, few by construction), the blocks before in the shard
    and the documents before in the block.
    """
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = table.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before_shard"))
    blocks = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n"))
                          .alias("before_block"))
    before = blocks.join(shards, "shard").select("shard", "block", (F.col("before_shard") + F.col("before_block")).alias("first"))
    dictionary = read_dictionary(spark, path)
    digest, shared = hashlib.sha256(dictionary).hexdigest(), spark.sparkContext.broadcast(dictionary)
    kind, last = ("long", "ids_crc32") if checksums else ("array<long>", "ids")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _decompressor(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError(f"block {row['shard']}/{row['block']} was written with another dictionary")
                ends = [0, *row["ends"]]
                counts = np.array(row["n_tokens"], np.int64)
                wide = [
                    np.frombuffer(frames.decompress(row["data"][a:b], max_output_size=n * row["id_bytes"]),
                                  f"<u{row['id_bytes']}").astype("<u4")
                    for a, b, n in zip(ends[:-1], ends[1:], row["n_tokens"], strict=True)
                ]
                values = ([zlib.crc32(x.tobytes()) for x in wide] if checksums else [x.astype(np.int64) for x in wide])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + np.cumsum(counts) - counts, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(values, pa.int64() if checksums else pa.list_(pa.int64())),
                ], ["doc_id", "start", "n_tokens", last])

    # The index is small beside the data: blocks keep their places and only their starts move.
    return table.join(F.broadcast(before) if _few(before) else before, ["shard", "block"]).mapInArrow(
        documents, f"doc_id long, start long, n_tokens long, {last} {kind}")


#: Blocks up to which their starts (three numbers each) are broadcast.
BROADCAST_BLOCKS = 100_000


def _few(before: DataFrame) -> bool:
    return len(before.limit(BROADCAST_BLOCKS + 1).select("block").toArrow()) <= BROADCAST_BLOCKS


def blocks_of(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The blocks that hold this id; others are skipped by their range before their data are read. Null ids begin a block."""
    inside = (F.col("first_doc_id").isNull() | (F.col("first_doc_id") <= doc_id)) & (F.col("last_doc_id") >= doc_id)
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter(inside).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every row with this id, from the frames of those documents alone."""
    frames = _decompressor(read_dictionary(spark, path))
    found = []
    hit = blocks_of(spark, path, doc_id)
    for row in hit.orderBy("shard", "block").toLocalIterator():
        ends = [0, *row.ends]
        for i, name in enumerate(row.doc_ids):
            if name == doc_id:
                data = frames.decompress(bytes(row.data[ends[i]:ends[i + 1]]), max_output_size=row.n_tokens[i] * row.id_bytes)
                found.append(np.frombuffer(data, f"<u{row.id_bytes}").tolist())
    return found
