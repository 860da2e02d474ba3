"""Operator 10: token ids written as frequency-ranked, byte-aligned variable-length integers.

File format. A folder with two Parquet tables. ``ranks``: one row, the token ids by falling corpus frequency (an id's
place there is its rank). ``blocks``: rows of up to ``BLOCK`` documents and ``BLOCK_TOKENS`` tokens (a document with more
is a row of its own) in ascending doc_id order (nulls first), with
the documents' ids, null flags and token counts, and two separate byte streams: *control* holds two bits a token (the
number of its data bytes less one), four tokens a byte, *data* holds the ranks in 1 to 4 little-endian bytes. The
frequent half of the vocabulary takes one byte. Decoding looks each control byte up in a table of lengths.

Defined results: null text counts as empty and has the end id alone; rows that share a doc_id keep a row each, in the
order of their ids' crc32; an empty table gives an empty folder of blocks; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import discard, scratch_path, stored, table

BLOCK, BLOCK_TOKENS = 512, 1 << 20
BLOCKS = "shard long, block long, doc_ids binary, nulls binary, counts binary, control binary, data binary"


def tokenised(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", counted: bool = False) -> DataFrame:
    """(doc_id, ids, width): each whole text's ids and the end id, as little-endian unsigned 16- or 32-bit integers.

    With ``counted`` there is a column ``counts`` too, null in these rows, and a row a task in which it holds how often the
    task met each id.
    """
    names = ["doc_id", "ids", "width", "counts"][: 4 if counted else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer)
        kind = np.dtype("<u2" if encoder.size <= 1 << 16 else "<u4")
        total = np.zeros(encoder.size, "<i8")
        for part, ids, ends in bpe.documents(encoder, batches):
            borders = pa.py_buffer(np.r_[0, ends * kind.itemsize].astype(np.int32))
            rows = pa.Array.from_buffers(pa.binary(), len(ends), [None, borders, pa.py_buffer(ids.astype(kind))])
            columns = [part.column(0).cast(pa.int64()), rows, pa.array(np.full(len(ends), kind.itemsize, np.int32)), pa.nulls(len(ends), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)
            if counted:
                total += np.bincount(ids, minlength=len(total))
        if counted:
            row = zip([None, None, None, total.tobytes()], [pa.int64(), pa.binary(), pa.int32(), pa.binary()])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names)

    schema = "doc_id long, ids binary, width int" + ", counts binary" * counted
    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the counts of the tasks that made the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0):
                total = np.frombuffer(counts.as_buffer(), "<i8")
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = tokens.where("counts is not null").select("counts")
    return counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF).astype(np.int64) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: For each control byte the lengths that its four pairs of bits stand for.
LENGTHS = 1 + (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3)


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count].astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    values = np.zeros(count, np.uint32)
    for k in range(int(size.max(initial=0))):
        has = size > k
        values[has] |= raw[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> str:
    """Tokenise ``docs`` (doc_id, text) and write them to ``folder``."""
    spark = docs.sparkSession
    tokens = stored(tokenised(docs, tokenizer or bpe.default_tokenizer(), counted=True), "tokens", compression="zstd")
    # bounded by the vocabulary
    counts = frequencies(tokens).orderBy(F.desc("n"), "id").toPandas()
    order = counts["id"].to_numpy(np.int64)
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(order.max(initial=-1)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, waiting, held, rank = TaskContext.get().partitionId(), 0, [], 0, shared.value

        def block() -> pa.RecordBatch:
            keys = np.array([k or 0 for k, _ in waiting], "<i8")
            ids = [x for _, x in waiting]
            control, data = encode(rank[np.concatenate(ids)])
            row = [shard, number, keys.tobytes(), bytes(k is None for k, _ in waiting), np.array([len(x) for x in ids], "<u4").tobytes(), control, data]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, [pa.int64()] * 2 + [pa.binary()] * 5)], BLOCKS.replace(" binary", "").replace(" long", "").split(", "))

        for batch in batches:
            for key, ids, width in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ids) // width
                if len(waiting) == BLOCK or waiting and held + n > block_tokens:
                    yield block()
                    waiting, held, number = [], 0, number + 1
                waiting.append((key, np.frombuffer(ids, f"<u{width}")))
                held += n
        if waiting:
            yield block()

    shards = max(1, tokens.rdd.getNumPartitions())
    # the ids' crc32 deals rows that share a doc_id, or have none
    in_order = tokens.where("counts is null").drop("counts").repartitionByRange(shards, F.asc("doc_id"), F.crc32("ids")).sortWithinPartitions("doc_id", F.crc32("ids"))
    in_order.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(tokens)
    return folder


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, with ``ids``, ids array<int>) from a written folder."""
    with_ids = ids
    order = np.frombuffer(spark.read.parquet(f"{folder}/ranks").first()["ids"], "<u4")
    shared = spark.sparkContext.broadcast(order)
    schema = T.StructType.fromDDL(BLOCKS)
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    names = ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ids = order[decode(row["control"], row["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                keys = [None if gone else int(k) for k, gone in zip(np.frombuffer(row["doc_ids"], "<i8"), row["nulls"])]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - counts, ends)]
                where = [[row["shard"]] * len(keys), [row["block"]] * len(keys), keys]
                columns = [pa.array(c, pa.int64()) for c in (*where, ends - counts, counts, crcs)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(x, "<u4").sum()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["shard", "block", "n"])

    docs = blocks.mapInArrow(run, ", ".join(f"{name} {'array<int>' if name == 'ids' else 'long'}" for name in names))
    # starts: a running sum within each shard, and one over the shards' totals, of which there are few
    block = blocks.select("shard", "block", "counts").mapInArrow(sizes, "shard long, block long, n long")
    shard = block.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shard.select("shard", F.expr("sum(n) over (order by shard) - n").alias("shard_start"))
    starts = block.select("shard", "block", F.expr("sum(n) over (partition by shard order by block) - n").alias("block_start")).join(before, "shard")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), *names[4:])


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))
    return read(spark, folder, ids=False)
