"""Operator 6: near-duplicate detection with MinHash bands and odd sketches.

A document is its set of word shingles. ``BANDS`` x ``ROWS`` MinHash values give banded buckets (at a similarity of
0.8 a pair misses all of them with probability 3e-6); the same values are folded into a parity bitmap (odd sketch),
whose XOR population count estimates high similarities; candidates at or above ``ESTIMATE`` (4.7 standard deviations
below 0.8) are confirmed on the full sets. For another ``percent`` of 50 to 100 the rows of a band and the estimate that
rules out are derived, so that neither loses a larger share of pairs than at 80.

Documents with equal sets are one class from the start. Within a bucket no pairs are listed: each round compares every
member with one pivot of its bucket (first the member that shares most buckets, then members picked by hash), merges
what is confirmed into components, and goes on with the buckets that still hold several. A pivot has met all members,
so it leaves its bucket; a bucket of up to ``PIVOT_ROUNDS`` + 1 members is settled by the rounds alone. What they leave
is compared completely: buckets are cut into blocks of ``BLOCK`` members, a task compares the sketches of two blocks,
and only candidates between different components leave it. So no link between components is lost, however large a
bucket. A second parity bitmap, of the whole set, rules pairs out for certain: every bit of its XOR is owed to at least
one differing shingle, and a linked pair of sets with s elements together differs in at most s (100 - t) / (100 + t).
Full sets are built for the documents of pairs that pass both, once each.

Defined results: null texts and texts without words have no shingle and link with nothing; equal rows link with each
other; rows that share a doc_id share a component; a null doc_id has no component and is kept; an empty table gives an
empty result; very long texts are hashed in pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, only, stored, table
from .components import components

BANDS, ROWS = 32, 5
SKETCH_BITS = 512
#: Estimated similarity below which sketches rule a pair out, and the percent that it and the bands are meant for; the
#: smallest percent covered, below which whole bitmaps of a pair can lie more than one folding apart.
ESTIMATE, PERCENT, LEAST_PERCENT = 0.65, 80, 50
PIVOT_ROUNDS = 3
BLOCK = 256
#: Words remembered by a worker, and shingles that are hashed together.
REMEMBERED, TOGETHER = 300_000, 2048

_draw = np.random.default_rng(20240607)
FACTORS = (_draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
OFFSETS = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * K2
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z is lower-cased, words end at ASCII white space."""
    words = (text or "").encode().lower().split()  # bytes: ASCII rules for both
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * K1 + h[k : k + n])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), TOGETHER):
        np.minimum(out, (low[i : i + TOGETHER, None] * FACTORS + OFFSETS).min(0), out=out)
    return out


def band_rows(percent: int) -> int:
    """The most rows a band, up to ``ROWS``, by which a pair at ``percent`` is missed no likelier than one at ``PERCENT`` by the usual bands."""
    missed = lambda p, r: (1 - (p / 100) ** r) ** (BANDS * ROWS // r)
    return next(r for r in range(ROWS, 0, -1) if missed(percent, r) <= missed(PERCENT, ROWS) or r == 1)


def least_estimate(percent: int) -> float:
    """The estimate that rules out: as many standard errors below ``percent`` as ``ESTIMATE`` is below ``PERCENT``, and no higher than it."""

    def error(p: int) -> float:
        odd = 2 * BANDS * ROWS * (1 - p / 100)  # samples that differ
        sketch = SKETCH_BITS / 4 * np.expm1(4 * odd / SKETCH_BITS) - odd
        return float(np.sqrt(p / 100 * (1 - p / 100) / (BANDS * ROWS) + sketch / (2 * BANDS * ROWS) ** 2))

    return min(ESTIMATE, percent / 100 - (PERCENT / 100 - ESTIMATE) * error(percent) / error(PERCENT))


def buckets(values: np.ndarray, each: int = ROWS) -> np.ndarray:
    bands = len(values) // each
    rows = values[: bands * each].reshape(bands, each).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(each):
        out = mixed(out * K1 + rows[:, k])
    return out.view(np.int64)


def odd_sketch(values: np.ndarray) -> bytes:
    places = mixed(np.arange(len(values), dtype=np.uint64) * K1 + values) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def estimated(differing: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the XOR population count of two odd sketches."""
    share = np.clip(1 - 2 * differing / SKETCH_BITS, 1e-9, None)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log(share)


def whole_bitmap(hashes: np.ndarray) -> bytes:
    """Parity bitmap of all shingles, about two bits for each; half of it, folded by XOR, is that of half the size."""
    size = 1 << max(9, min(16, int(2 * len(hashes) - 1).bit_length()))
    places = (hashes >> np.uint64(16)) & np.uint64(size - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=size) & 1).tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(bitmap, np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def features(docs: DataFrame, width: int, each: int = ROWS) -> DataFrame:
    names = ["doc_id", "n", "digest", "sketch", "bands", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("near_dedup", _hashes.clear)
        with np.errstate(over="ignore"):
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    rows = []
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        own = shingle_set(text, width)
                        low = minima(own)
                        rows.append((key, len(own), xxhash.xxh3_128_digest(own.tobytes()), odd_sketch(low), buckets(low, each), whole_bitmap(own)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch binary, bands array<long>, bitmap binary")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int, repeated: bool) -> DataFrame:
    """(node, hashes) for the documents in ``nodes``; ``repeated`` says whether a doc_id may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("near_dedup", _hashes.clear)
        with np.errstate(over="ignore"):
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    sets = [shingle_set(t, width).tobytes() for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    own = own.distinct() if repeated else own
    return own.mapInArrow(run, "node long, hashes binary")


def close_enough(percent: int) -> Column:
    """Sizes that allow the similarity, and sketches that make it likely; for columns n_a, n_b, sketch_a, sketch_b."""
    bits = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        part = lambda c: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")  # noqa: B023, E731
        bits = bits + F.bit_count(part("sketch_a").bitwiseXOR(part("sketch_b")))
    most = int(SKETCH_BITS / 2 * (1 - np.exp((least_estimate(percent) - 1) * 4 * BANDS * ROWS / SKETCH_BITS)))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (bits <= most)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                union = len(np.union1d(one, two))
                keep.append(100 * (len(one) + len(two) - union) >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    return both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def with_pivots(members: DataFrame, order: Column) -> DataFrame:
    """Each other member of a bucket that holds several components, with the bucket's pivot."""
    pivot = members.groupBy("bucket").agg(F.max(F.struct(order.alias("o"), "node", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    pivot = pivot.select("bucket", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pivot_comp"))
    return members.join(pivot, "bucket").where("node <> pivot").select("bucket", "node", "comp", "pivot", "pivot_comp")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that neither sizes, odd sketches nor whole bitmaps rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for total, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))
                keep.append(differ * (100 + percent) <= total * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(name: str, *columns: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").where(close_enough(percent)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"))
    both = near.join(side("a", "bitmap"), "a").join(side("b", "bitmap"), "b")
    return both.select("a", "b", "total", "bitmap_a", "bitmap_b").mapInArrow(run, "a long, b long")


def remaining_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All candidates between different components, from buckets that hold several; blocks against blocks."""
    several = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sign")).where("low < high")
    once = several.groupBy("size", "sign", "low").agg(F.min("bucket").alias("bucket"))  # buckets of the same members count once
    placed = members.join(once.select("bucket", "size"), "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    placed = placed.join(nodes.select("node", "n", "sketch", "bitmap"), "node")
    dealt = placed.select("bucket", "node", "comp", "n", "sketch", "bitmap", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")

    least = least_estimate(percent)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        node, comp, n, block = (group.column(c).to_numpy() for c in ("node", "comp", "n", "block"))
        bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        bitmaps = group.column("bitmap").to_pylist()
        sizes = np.array([len(b) for b in bitmaps])
        # by size the bitmaps that are folded to it: sizes of a pair are equal or next to each other
        at_size = {z: np.stack([folded(b, z) if len(b) in (z, 2 * z) else np.zeros(z // 8, np.uint64) for b in bitmaps]) for z in {*sizes.tolist()}}
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        out = []
        for i in left:
            rest = right[comp[right] != comp[i]]
            rest = rest[np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * percent]
            rest = rest[estimated(np.bitwise_count(bits[rest] ^ bits[i]).sum(1)) >= least]
            for z in {*np.minimum(sizes[rest], sizes[i]).tolist()}:
                some = rest[np.minimum(sizes[rest], sizes[i]) == z]
                differ = np.bitwise_count(at_size[z][some] ^ at_size[z][i]).sum(1, dtype=np.int64)
                some = some[differ * (100 + percent) <= (n[some] + n[i]) * (100 - percent)]
                out.append(np.stack([np.minimum(node[i], node[some]), np.maximum(node[i], node[some])]))
        pairs = np.unique(np.concatenate(out or [np.zeros((2, 0), np.int64)], 1), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text); ``percent`` from ``LEAST_PERCENT`` to 100."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100: {percent}")
    found = stored(features(docs, width, band_rows(percent)), "near-features")
    classes = stored(found.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node")), "near-classes")
    first = F.first
    nodes = (
        found.join(classes, "digest").where("doc_id = node").groupBy("digest", "node").agg(first("n").alias("n"), first("sketch").alias("sketch"), first("bands").alias("bands"), first("bitmap").alias("bitmap")).drop("digest")
    )
    nodes = stored(nodes, "near-nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    weight = F.sum("size").over(Window.partitionBy("node"))  # a node has one row a band, at most BANDS * ROWS
    members = stored(rows.join(shared, "bucket").select("bucket", "node", F.col("node").alias("comp"), weight.alias("weight")), "near-members")
    repeated = bool(found.groupBy("doc_id").count().where("count > 1").limit(1).count())
    sets, links = None, []
    for k in range(PIVOT_ROUNDS + 1):
        if k < PIVOT_ROUNDS:
            met = stored(with_pivots(members, F.col("weight") if k == 0 else F.xxhash64("node", F.lit(k))), "near-met")
            discard(members)
            pairs = met.where("comp <> pivot_comp").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
            pairs, members = stored(likely(pairs, nodes, percent), "near-pairs"), met.select("bucket", "node", "comp")
        else:
            pairs = stored(remaining_pairs(members, nodes, percent), "near-pairs")
        if not pairs.limit(1).count():
            continue
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if sets is None:
            sets = stored(full_sets(docs, needed, width, repeated), "near-sets")
        else:
            needed = stored(needed.join(sets.select("node"), "node", "left_anti"), "near-needed")
            sets = sets.unionByName(stored(full_sets(docs, needed, width, repeated), "near-sets"))
        good = stored(confirmed(pairs, sets, percent), "near-links")
        discard(pairs)
        links.append(good)
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        if k == PIVOT_ROUNDS or not good.limit(1).count():
            continue
        merged = components(every)
        members = stored(met.select("bucket", "node").join(merged, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp")), "near-members")
        discard(met)
    if links:
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        final = components(every)
        classes = classes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    else:
        classes = classes.select("digest", F.col("node").alias("component"))
    out = found.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM t),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM x GROUP BY g),
p AS (SELECT doc_id, n, g FROM x JOIN f USING (g) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, g) <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT a, b, len(list_intersect(y.s, z.s)) AS shared, len(y.s) + len(z.s) AS total FROM c JOIN s y ON y.doc_id = a JOIN s z ON z.doc_id = b),
e AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * (total - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS m FROM s UNION SELECT r.d, u.b FROM r JOIN u ON u.a = r.m),
m AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON d = doc_id
"""
