"""Operator 1: exact deduplication of a batch against immutable snapshots, screened by static binary-fuse filters.

A snapshot keeps one row for each distinct text (digest, largest doc_id, count) in buckets by digest, and a filter
for each bucket. An incoming batch is grouped by digest on its own; the filters screen its digests bucket by bucket;
only positives join the snapshot's exact buckets; texts that share a digest are compared byte by byte.
Keys are pre-aggregated before every shuffle, so a text with a third of all rows is a few rows by then; what is
joined by row is left to Spark's skew handling of joins.

Defined results: null text equals the empty text; of rows with equal text that with the largest doc_id stays (rows
that repeat this doc_id are the same document and stay with it); a null doc_id loses against any other and a group of
nulls alone stays; an empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse_filter
from .common import stored, table, text_or_empty

#: Digests of a bucket, of the snapshot or the batch, whichever has more; one task builds its filter and one screens it.
BUCKET_DIGESTS = 250_000


@dataclass
class Snapshot:
    groups: DataFrame  # bucket, digest, keep_id, n
    filters: DataFrame  # bucket, filter
    buckets: int


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(buckets)).cast("int")


def snapshot(rows: DataFrame, buckets: int | None = None, incoming: int = 0) -> Snapshot:
    """Freeze (doc_id, digest) rows: exact groups and a filter for each bucket; ``incoming`` rows are to be screened by them."""
    groups = stored(grouped(rows), "exact-groups")
    buckets = buckets or max(1, -(-max(groups.count(), incoming) // BUCKET_DIGESTS))
    groups = groups.withColumn("bucket", bucket_of(buckets))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "filter": [fuse_filter.build(pdf["key"].to_numpy("int64").view("uint64"))]})

    filters = groups.select("bucket", F.xxhash64("digest").alias("key")).groupBy("bucket").applyInPandas(make, "bucket int, filter binary")
    return Snapshot(groups, stored(filters, "fuse-filters"), buckets)


def screen(groups: DataFrame, against: Snapshot) -> DataFrame:
    """Incoming groups with ``maybe``: false where the snapshot's filter rules the digest out."""

    def probe(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        keys = batch.pop("key").to_numpy("int64").view("uint64")
        batch["maybe"] = fuse_filter.contains(filters["filter"].iloc[0], keys) if len(filters) else False
        return batch[["digest", "keep_id", "n", "maybe"]]

    keyed = groups.select("digest", "keep_id", "n", bucket_of(against.buckets).alias("bucket"), F.xxhash64("digest").alias("key"))
    return keyed.groupBy("bucket").cogroup(against.filters.groupBy("bucket")).applyInPandas(probe, "digest binary, keep_id long, n long, maybe boolean")


def merged_groups(incoming: DataFrame, against: Snapshot) -> DataFrame:
    """(digest, keep_id, n) of snapshot and batch together: the snapshot's groups stay as they are but for those that positives meet."""
    screened = stored(screen(grouped(incoming), against), "screened")
    new = screened.where("not maybe").select("digest", "keep_id", "n")
    # positives join the exact buckets; both sides hold a digest once
    hits = screened.where("maybe").select("digest", F.col("keep_id").alias("in_keep"), F.col("n").alias("in_n"))
    met = stored(hits.join(against.groups, "digest", "left"), "met")
    false = met.where("n is null").select("digest", F.col("in_keep").alias("keep_id"), F.col("in_n").alias("n"))
    changed = met.where("n is not null").select("digest", F.greatest("keep_id", "in_keep").alias("keep_id"), (F.col("n") + F.col("in_n")).alias("n"))
    same = against.groups.select("digest", "keep_id", "n").join(changed.select("digest"), "digest", "left_anti")
    return same.unionByName(changed).unionByName(new).unionByName(false)


def check_bytes(docs: DataFrame, copies: DataFrame) -> None:
    """Compare the texts behind each digest; raises if two differ. ``copies``: (doc_id, digest) of groups of several."""
    own = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    some = copies.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "digest").distinct()
    ends = own.join(some, ["id", "digest"], "left_semi").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    if ends.where("a <> b").limit(1).count():
        raise RuntimeError("different texts share a SHA-256 digest")


def dedup(docs: DataFrame, cut: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Rows below ``cut`` (the middle of the doc_ids, if not given) are the snapshot, the others the incoming batch.
    """
    rows = stored(digests(docs), "digests")
    if cut is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        cut = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") < cut, F.lit(False))
    batch = rows.where(~old)
    groups = merged_groups(batch, snapshot(rows.where(old), incoming=batch.count()))
    out = rows.join(groups, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
    out = stored(out, "exact-dedup")
    check_bytes(docs, out.where("group_size > 1"))
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged."""
    gone = dedup(docs).where("not kept").select(F.coalesce("doc_id", F.lit(-1)).alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = (F.coalesce(docs["doc_id"], F.lit(-1)) == gone["gone_id"]) & (F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == gone["gone_digest"])
    return docs.join(gone, same, "left_anti")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
