"""Operator 3: best-fit packing of documents into sequences by hierarchical residual packing.

Every partition packs its pieces best-fit (longest first). Nearly full sequences are done: those with less room than the
smallest sequence that is still open, beside which nothing can come any more. The underfull ones go on as items of their
own to the next round, which has fewer partitions (``FAN_IN`` into one, yet never more than
``TOGETHER`` items each). The rounds end when one partition held all items, or when a round saved less than one in a
thousand. The state between rounds is a Parquet table in the shared folder, so a lost executor costs a task.

Defined results: null and empty texts are one piece with the end id alone; rows that share a doc_id are packed each
for itself; a null doc_id stays null; an empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import stored, table

LENGTH = 1024
FAN_IN = 8
#: Items of a partition in later rounds: a bound on a task's memory.
TOGETHER = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = f"used int, closed boolean, members array<struct<{PIECES.replace(' ', ':').replace(',:', ',')}>>"
MEMBER = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Best-fit decreasing in O(n): open bins by free space, the tightest found in the bits of an integer."""
    free: list[list[int]] = [[] for _ in range(length + 1)]
    bins: list[list[int]] = []
    open_bits = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                open_bits &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = length, len(bins)
            bins.append([i])
        left = room - size
        if left:
            free[left].append(at)
            open_bits |= 1 << left
    return bins


def pieces_of(ids: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32): documents longer than ``length`` are cut, the first piece is the shorter one."""
    total = len(ids)
    head = total % length or min(length, total)
    cuts = [0, *range(head, total + 1, length)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _bins(rows: list[tuple[int, list[tuple]]], length: int) -> Iterator[pa.RecordBatch]:
    """Pack (size, members) items; members are tuples in the order of MEMBER."""
    rows.sort(key=lambda r: (-r[0], r[1][0][0] is not None, r[1][0][0] or 0, r[1][0][1]))
    packed = best_fit([r[0] for r in rows], length)
    for i in range(0, len(packed), 5000):
        some = packed[i : i + 5000]
        members = [m for b in some for k in b for m in rows[k][1]]
        ends = np.cumsum([0, *(sum(len(rows[k][1]) for k in b) for b in some)])
        used = [sum(rows[k][0] for k in b) for b in some]
        fields = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*members), MEMBER)], [n for n, _ in MEMBER])
        nested = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([u == length for u in used]), nested], ["used", "closed", "members"])


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, together: int = bpe.TOGETHER) -> DataFrame:
    """(sequence_id, used, members): one row for each sequence, its pieces in order.

    ``together``: bytes of text whose ids a task puts together at once; what it looks up together and remembers follows.
    """
    spark, path = docs.sparkSession, tokenizer or bpe.default_tokenizer()
    share = min(1, together / bpe.TOGETHER)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for part, ids, ends in bpe.documents(bpe.encoder(path, share), batches, together):
            whole = []
            for key, a, b in zip(part.column(0).to_pylist(), np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                for p in pieces_of(ids[a:b], length):
                    (whole if p[2] == length else waiting).append((p[2], [(key, *p)]))
            if whole:
                yield from _bins(whole, length)
            if len(waiting) > TOGETHER:
                yield from _bins(waiting, length)
                waiting = []
        yield from _bins(waiting, length)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            nested = batch.column(1)
            members = [*zip(*(c.to_pylist() for c in nested.flatten().flatten()))]
            ends = np.cumsum([0, *nested.value_lengths().to_pylist()])
            rows += [(u, members[a:b]) for u, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:])]
        yield from _bins(rows, length)

    def parted(state: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Sequences that are done, open ones, and how many are open."""
        # one row a size, of which there are ``length``
        sizes = {r["used"]: r["count"] for r in state.where("not closed").groupBy("used").count().collect()}
        most = length - min(sizes, default=length)
        goes_on = ~F.col("closed") & (F.col("used") <= most)
        return state.where(~goes_on), state.where(goes_on), sum(n for used, n in sizes.items() if used <= most)

    state = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, BINS), "packed")
    parts = max(1, state.rdd.getNumPartitions())
    done, open_bins, count = parted(state)
    while count > 1 and parts > 1:
        least = -(-count // TOGETHER)
        parts = max(-(-parts // FAN_IN), least)
        key = F.expr("xxhash64(members[0].doc_id, members[0].piece)")
        state = stored(open_bins.select("used", "members").repartition(parts, key).mapInArrow(later, BINS), "packed")
        before, (full, open_bins, count) = count, parted(state)
        done = done.unionByName(full)
        if (before - state.count()) * 1000 < before and parts == least:
            break
    return done.unionByName(open_bins).select(F.monotonically_increasing_id().alias("sequence_id"), "used", "members")


def placed(sequences: DataFrame) -> DataFrame:
    """One row for each piece, with its place in its sequence."""
    ends = "aggregate(slice(members, 1, at), 0L, (s, m) -> s + m.length)"
    return sequences.select("sequence_id", "members", F.posexplode("members").alias("at", "m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", F.expr(ends).alias("offset")
    )


def sequences_with_ids(docs: DataFrame, sequences: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(sequence_id, input_ids): the packed sequences themselves, for a trainer. doc_id must be unique here."""
    from .token_output import tokenised

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.frombuffer(r["ids"], f"<u{r['width']}")[r["start"] : r["start"] + r["length"]].astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["sequence_id"] for r in rows], pa.int64()), pa.array([r["offset"] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    tokens = tokenised(docs, tokenizer or bpe.default_tokenizer())
    found = placed(sequences).join(tokens, "doc_id").select("sequence_id", "offset", "start", "length", "ids", "width")
    parts = found.mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids))").alias("input_ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(pack(table(spark, sf_dir, "documents")))
