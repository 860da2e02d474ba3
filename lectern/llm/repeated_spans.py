"""Operator 7: removal of repeated byte strings by distributed prefix doubling.

A string of ``LENGTH`` (50) bytes goes from a document if a document with a smaller doc_id has it. Ranks stand for equal
strings; Spark sorts (rank, position) rows at growing lengths, and positions whose rank is met in one document only, or
that are past the threshold, leave. The documents are stored once as a table bucketed by block (about ``BLOCK_BYTES`` of
text), so that no round shuffles text. Copies of whole documents are found by their digests and take no part.

1. Within a block ranks are doubled from 1 to 25 bytes at every position; neighbours lie in the same document, so this
   needs no exchange. Of the 26 ranks inside a string the smallest stands for it: equal strings have equal
   representatives. Neighbouring strings under one representative are a *run*, at most 26 of them.
2. First sort, 25 bytes: the representatives, one row a block. Those that one document alone has leave.
3. Second sort, 50 to 75 bytes: each remaining run as a whole, by the ranks at its start, 25 bytes on and 25 bytes
   before its end. A run that a smaller doc_id has goes as a whole; where a representative has one run only, all is
   settled.
4. Third sort, 50 bytes: of the others the first holder of each run sends its bytes; the strings in it are sorted and
   compared as they are.

Rows are combined within their block before every sort, so a string in a third of all documents is a row a block; a
representative with more than about ``HOT`` runs is dealt by its runs and strings instead of by itself (every other run
of it sends its bytes, so that is for the few that would burden a task, not for all that many blocks have). In the second sort
equality of runs rests on 192 bits (the three ranks), within a block as between blocks, in the third on bytes.

Defined results: null text is the empty text; rows that share a doc_id do not remove each other's bytes; a null doc_id
counts as larger than any other; texts under 50 bytes keep everything; an empty table gives an empty result; very long
texts are ranked in pieces, and are a block of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_folder, stored, table, text_or_empty

LENGTH = 50
#: Bytes of text in a block, bytes that are ranked together, runs from which on a representative is dealt by them.
BLOCK_BYTES, PIECE_BYTES, HOT = 8 << 20, 1 << 20, 1 << 16
LAST = (1 << 63) - 1

BASE = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def doubled(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length``-byte strings at every position, from pairs of ranks at growing offsets."""
    rank, have, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if length & have:  # this power of two is part of the length
            if out is None:
                out = rank
            else:
                n = len(rank) - done
                out = out[:n] * np.uint64(pow(BASE, have, 1 << 64)) + rank[done : done + n]
            done += have
        if done == length:
            return mixed(out[: max(0, len(data) - length + 1)])
        rank = rank[:-have] * np.uint64(pow(BASE, have, 1 << 64)) + rank[have:]
        have *= 2


def smallest(rank: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over ``width`` neighbours."""
    low, have = rank, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if width > have else low


class Block:
    """The documents of a block one after another in ascending order of doc_id, and the runs of their strings."""

    def __init__(self, group: pa.Table, back: pa.Table, length: int) -> None:
        self.length = length
        self.row = group.column("row").to_numpy()
        self.null = np.array(group.column("doc_id").is_null())
        key = group.column("doc_id").fill_null(LAST).to_numpy()
        order = np.argsort(key, kind="stable")
        self.key, self.row, self.null = key[order], self.row[order], self.null[order]
        text = pa.concat_arrays([c.cast(pa.large_binary()) for c in group.column("text").chunks]) if group.num_rows else pa.array([], pa.large_binary())
        text = text.take(pa.array(order))
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        self.data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        self.start, self.stop = ends[:-1] - ends[0], ends[1:] - ends[0]
        self.copy = np.isin(self.row, of_kind(back, "copy")[0][0])

    def runs(self, bits: int = 64) -> dict[str, np.ndarray]:
        """rank (of the representative), at, n, doc, e1 (cut to ``bits``), e2 of every run, in the order of the text."""
        half, size = self.length // 2, len(self.data)
        # strings that start in the last bytes of a document, or in a copy, do not count
        counts = np.where(self.copy, 0, np.maximum(self.stop - self.start - self.length + 1, 0))
        step = np.zeros(size + 1, np.int8)
        some = counts > 0
        np.add.at(step, self.start[some], 1)
        np.add.at(step, (self.start + counts)[some], -1)
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        found: dict[str, list] = {k: [] for k in ("rank", "at", "n", "e1", "e2")}
        with np.errstate(over="ignore"):
            for i in range(0, max(size - self.length + 1, 0), PIECE_BYTES):
                part = self.data[i : i + PIECE_BYTES + self.length - 1]
                rank = doubled(part, half)
                low = smallest(rank, self.length - half + 1)
                here = inside[i : i + len(low)]
                change = np.r_[True, (low[1:] != low[:-1]) | (here[1:] != here[:-1])]
                at = np.flatnonzero(change)
                n = np.diff(np.r_[at, len(low)])
                at, n = at[here[at]], n[here[at]]
                most = self.length - half + 1
                if len(n) and n.max() > most:  # a period shorter than the width
                    times = -(-n // most)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at, n = np.repeat(at, times) + most * nth, np.minimum(np.repeat(n, times) - most * nth, most)
                pair = mixed(rank[at] * np.uint64(BASE) + rank[at + half])
                end = rank[at + n - 1 + self.length - half] + n.astype(np.uint64)
                found["rank"].append(low[at])
                found["at"].append(at + i)
                found["n"].append(n)
                found["e1"].append(mixed(pair * M1 + end) >> np.uint64(64 - bits))
                found["e2"].append(mixed((pair ^ (end * M2)) * np.uint64(BASE) + end))
        out = {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("rank", "e1", "e2") else np.int64) for k, v in found.items()}
        out["doc"] = np.searchsorted(self.stop, out["at"], side="right")
        return out


def chosen(runs: dict[str, np.ndarray], some: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[some] for k, v in runs.items()}


def ordered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A stable order in which rows with equal keys are neighbours, and where in it new keys start."""
    order = np.argsort(keys[0], kind="stable")
    steps = [key[order][1:] != key[order][:-1] for key in keys]
    if any((step & ~steps[0]).any() for step in steps[1:]):  # the first key alone does not tell all rows apart
        order = np.lexsort(keys[::-1])
        steps = [key[order][1:] != key[order][:-1] for key in keys]
    return order, np.flatnonzero(np.r_[True, np.logical_or.reduce(steps)]) if len(order) else np.zeros(0, np.int64)


def firsts(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first row of each key (in the order of the text), whether another document has it too, and how many rows have it."""
    order, start = ordered(keys)
    docs = doc[order]
    stop = np.r_[start[1:], len(docs)][: len(start)]
    places, many = order[start], docs[stop - 1] != docs[start]
    back = np.argsort(places)
    return places[back], many[back], (stop - start)[back]


def of_kind(back: pa.Table, kind: str, keys: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of the rows of a kind, and what is told of them."""
    some = back.filter(pc.equal(back.column("kind"), kind))
    return [some.column(k).to_numpy() for k in ("a", "c", "d")[:keys]], some.column("b").to_numpy()


def looked_up(values: list[np.ndarray], keys: list[np.ndarray], told: np.ndarray, none: int) -> np.ndarray:
    """What is told of each row (unsigned ranks against signed keys), ``none`` where it is not among the keys."""
    out = np.full(len(values[0]), none, np.int64)
    if not len(told):
        return out
    order = np.argsort(keys[0], kind="stable")
    keys, told, values = [key[order] for key in keys], told[order], [v.view(np.int64) for v in values]
    place = np.searchsorted(keys[0], values[0])
    # as many steps as keys agree in their first part: one, unless that happens
    starts = np.flatnonzero(np.r_[True, keys[0][1:] != keys[0][:-1], True])
    for step in range(np.diff(starts).max()):
        at = np.minimum(place + step, len(told) - 1)
        same = np.logical_and.reduce([key[at] == v for key, v in zip(keys, values)])
        out[same] = told[at[same]]
    return out


def of_run(own: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The three ranks that stand for a run."""
    return [own["e1"], own["e2"], own["rank"]]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


#: Rows told to a block: kind, key (row, representative, or a run's e1), what is told, and a run's other ranks (e2, rank).
BACK = ["block", "kind", "a", "b", "c", "d"]


def repeated_spans(docs: DataFrame, length: int = LENGTH, texts: bool = True, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (the bytes that stay) for each row of ``docs``.

    ``bits`` is the size of the first of a run's ranks; the result does not depend on it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, used, row = TaskContext.get().partitionId() << 28, 0, 0
        for batch in batches:
            blocks, rows, digests = [], [], []
            for text in batch.column(1):
                data = text.as_buffer()
                if used and used + data.size > BLOCK_BYTES or row == 1 << 20:
                    block, used, row = block + 1, 0, 0
                blocks.append(block)
                rows.append(row)
                used, row = used + data.size, row + 1
                digests.append(xxhash.xxh3_128_digest(data))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(rows, pa.int64()), *batch.columns, pa.array(digests, pa.binary())], ["block", "row", "doc_id", "text", "digest"])

    # a table of its own, as only tables have buckets; more blocks than Spark allows buckets share them
    name = f"lectern_spans_{uuid.uuid4().hex}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    path = f"{shared_folder(spark)}/{name}"
    own = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(number, "block long, row long, doc_id long, text string, digest binary")
    own.write.option("compression", "zstd").option("path", path).bucketBy(min(max(1, -(-size // BLOCK_BYTES)), most), "block").saveAsTable(name)
    try:
        out = _measured(spark.table(name), length, texts, bits)
        discard(spark.table(name))
        return out
    finally:
        spark.sql(f"DROP TABLE {name}")


def told_of(kind: str, rows: DataFrame, key: str, value: Column, *more: str) -> DataFrame:
    parts = [F.col("block"), F.lit(kind), F.col(key), value, *(F.col(m) for m in more), F.lit(0), F.lit(0)]
    return rows.select(*(part.cast("string" if name == "kind" else "long").alias(name) for part, name in zip(parts, BACK)))


def whole_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller doc_id has, to be told to their blocks."""
    order = F.coalesce("doc_id", F.lit(LAST))
    first = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = rows.join(first, "digest").where(order > F.col("first"))
    return told_of("copy", copies, "row", F.lit(0))


#: Bits of a head's tag below its block: whether several documents of the block have the rank, and the power of two of its runs there.
TAG_BITS = 6


def in_several(heads: DataFrame) -> DataFrame:
    """Of (rank, tag) rows, a row a block, those to go on with; runs are counted to within a factor of two."""
    same = Window.partitionBy("rank")
    runs = F.expr(f"shiftleft(1L, int(shiftright(tag, 1) % {1 << TAG_BITS - 1}))")
    counted = heads.select("rank", "tag", F.count(F.lit(1)).over(same).alias("n"), F.max(F.col("tag") % 2).over(same).alias("many"), F.sum(runs).over(same).alias("runs"))
    return told_of("mark", counted.where("n > 1 or many = 1").withColumn("block", F.shiftright("tag", TAG_BITS)), "rank", F.col("runs") > HOT)


def settled(runs: DataFrame) -> DataFrame:
    """From (rank, salt, e1, e2, tag, low, hot): ``dup`` (run, smallest doc_id) and ``send`` (run, hot) rows for the blocks."""
    dealt = runs.repartition("rank", "salt")
    one, every = Window.partitionBy("rank", "salt", "e1", "e2"), Window.partitionBy("rank", "salt")
    least = dealt.withColumn("least", F.min("low").over(one))
    other = (F.min("e1").over(every) != F.max("e1").over(every)) | (F.min("e2").over(every) != F.max("e2").over(every)) | F.col("hot")
    told = least.withColumn("several", other)
    dup = (F.col("least") < F.col("low")) | (F.col("tag") % 2 == 1)
    send = F.col("several") & (F.col("least") == F.col("low"))
    none = F.lit(None).cast("struct<kind:string,a:long,b:long,c:long,d:long>")
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col("e1").alias("a"), value.alias("b"), F.col("e2").alias("c"), F.col("rank").alias("d"))
    rows = F.array(F.when(dup, row("dup", F.col("least"))).otherwise(none), F.when(send, row("send", F.col("hot").cast("long"))).otherwise(none))
    return told.where(dup | send).select(F.shiftright("tag", 1).alias("block"), F.inline(F.array_compact(rows)))


def met_before(sent: DataFrame, length: int) -> DataFrame:
    """From (rank, block, e1, e2, doc, n, bytes, hot): ``edge`` rows (run, a bit for each string of it that a smaller doc_id has)."""
    run = ["rank", "block", "e1", "e2"]
    each = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    string = F.substring("bytes", F.col("i") + 1, F.lit(length)).alias("string")
    strings = lambda df: df.select(*run, "doc", "bytes", each).select(*run, "doc", "i", string)
    bit = F.expr("shiftleft(1L, i)")
    edge = lambda df: df.groupBy(*run).agg(F.bit_or(bit).alias("b"))
    # runs under a rare representative meet by it, and are opened after the exchange
    cold = strings(sent.where("not hot").repartition("rank"))
    cold = edge(cold.withColumn("least", F.min("doc").over(Window.partitionBy("rank", "string"))).where("least < doc"))
    # those under a frequent one meet by string, and only its smallest doc_id does
    hot = strings(sent.where("hot"))
    least = hot.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("string", "least")
    hot = edge(hot.join(least, "string").where("least < doc"))
    return told_of("edge", cold.unionByName(hot), "e1", F.col("b"), "e2", "rank")


def _measured(blocks: DataFrame, length: int, with_texts: bool, bits: int) -> DataFrame:
    names = lambda ddl: [x.split()[0] for x in ddl.split(", ")]
    heads, runs, sent = "rank long, tag long", "rank long, salt long, e1 long, e2 long, tag long, low long, hot boolean", "rank long, block long, e1 long, e2 long, doc long, n int, bytes binary, hot boolean"

    def first(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        own = Block(group, back, length).runs(bits)
        at, many, times = firsts([own["rank"]], own["doc"])
        power = np.frexp(times)[1].astype(np.int64) - 1
        return pa.table([signed(own["rank"][at]), pa.array((key[0].as_py() << TAG_BITS) + 2 * power + many)], names(heads))

    def marked(own: dict[str, np.ndarray], back: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        hot = looked_up([own["rank"]], *of_kind(back, "mark"), -1)
        return chosen(own, hot >= 0), hot[hot >= 0] == 1

    def second(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(group, back, length)
        own, hot = marked(block.runs(bits), back)
        at, many, _ = firsts(of_run(own), block.key[own["doc"]])
        own, hot = chosen(own, at), hot[at]
        salt = np.where(hot, own["e1"].view(np.int64), 0)
        columns = [signed(own["rank"]), pa.array(salt), signed(own["e1"]), signed(own["e2"]), pa.array(2 * key[0].as_py() + many), pa.array(block.key[own["doc"]]), pa.array(hot)]
        return pa.table(columns, names(runs))

    def third(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        if not len(of_kind(back, "send")[1]):
            return pa.table([pa.array([], t) for t in [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.bool_()]], names(sent))
        block = Block(group, back, length)
        own = block.runs(bits)
        hot = looked_up(of_run(own), *of_kind(back, "send", 3), -1)
        own, hot = chosen(own, hot >= 0), hot[hot >= 0]
        at, _, _ = firsts(of_run(own), own["doc"])
        own, hot = chosen(own, at), hot[at]
        data = block.data.tobytes()
        pieces = [data[a : a + n + length - 1] for a, n in zip(own["at"].tolist(), own["n"].tolist())]
        columns = [signed(own["rank"]), pa.array(np.full(len(at), key[0].as_py())), signed(own["e1"]), signed(own["e2"]), pa.array(block.key[own["doc"]]), pa.array(own["n"].astype(np.int32)), pa.array(pieces, pa.binary()), pa.array(hot == 1)]
        return pa.table(columns, names(sent))

    def remove(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(group, back, length)
        own = block.runs(bits) if back.num_rows else chosen(block.runs(bits), slice(0, 0))
        least = looked_up(of_run(own), *of_kind(back, "dup", 3), LAST)
        goes = least < block.key[own["doc"]]
        some = chosen(own, goes)
        step = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(step, some["at"], 1)
        np.add.at(step, some["at"] + some["n"] + length - 1, -1)
        edges = np.where(goes, 0, looked_up(of_run(own), *of_kind(back, "edge", 3), 0))
        for bit in range(length - length // 2 + 1):
            at = own["at"][(edges >> bit & 1) == 1] + bit
            np.add.at(step, at, 1)
            np.add.at(step, at + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        out = []
        for k, null, a, b, copy in zip(block.key.tolist(), block.null.tolist(), block.start.tolist(), block.stop.tolist(), block.copy.tolist()):
            here = np.full(b - a, True) if copy and b - a >= length else gone[a:b]
            kept = block.data[a:b][~here].tobytes()
            spans = int((here[1:] & ~here[:-1]).sum() + here[0]) if b > a else 0
            out.append((None if null else k, b - a, int(here.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_texts else None))
        types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
        return pa.table([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])

    def told(*parts: DataFrame):
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return blocks.groupBy("block").cogroup(every.groupBy("block"))

    copies = stored(whole_copies(blocks.select("block", "row", "doc_id", "digest")), "span-copies")
    marks = stored(in_several(told(copies).applyInArrow(first, heads)), "span-marks")
    found = stored(settled(told(copies, marks).applyInArrow(second, runs)), "span-runs")
    discard(marks)
    sending = found.where("kind = 'send'")
    edges = stored(met_before(stored(told(copies, sending).applyInArrow(third, sent), "span-sent"), length), "span-edges")
    result = told(copies, found.where("kind = 'dup'"), edges).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = stored(result, "span-results", compression="zstd")
    for used in (copies, found, edges):
        discard(used)
    return out


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), texts=False).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT r, doc_id, i, b[i:i + 49] AS s FROM (SELECT r, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM g JOIN m USING (s) WHERE first < doc_id),
n AS (SELECT r, i, least(50, coalesce(i - p, 50)) AS more, (p IS NULL OR i > p + 50)::INT AS opens, sum((p IS NULL OR i > p + 50)::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM h),
sp AS (SELECT r, span, min(i) AS a, max(i) + 50 AS z, sum(more) AS len FROM n GROUP BY r, span),
k AS (SELECT r, lag(z, 1, 1) OVER w AS a, a AS z FROM sp WINDOW w AS (PARTITION BY r ORDER BY span) UNION ALL SELECT r, max(z), 2147483647 FROM sp GROUP BY r),
kept AS (SELECT r, sha256(unhex(string_agg(CASE WHEN z > a THEN hex(b[a:z - 1]) ELSE '' END, '' ORDER BY a, z))) AS sha FROM k JOIN d USING (r) GROUP BY r),
t AS (SELECT r, sum(len) AS n_removed, count(*) AS n_spans FROM sp GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256(b)) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN kept USING (r)
"""
