"""The catalogue of books: merging, ordering, unique references, and looking books up by reference or title.

A selector is a reference (``B-`` and the beginning of an id), a title after ``title:``, or either, references first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import title_key
from lectern.operators.structure import unique_prefixes
from lectern.sources.scratch import stored

LEAST = 3


def listed(books: DataFrame) -> DataFrame:
    """books: (book_id, title, active) with hex ids -> with ``ref`` and ``place``: active ones first, then by title and id, compared as bytes.

    Places are numbered over ranges that Spark sorts, so no task sees all books.
    """
    refs = unique_prefixes(books.select(F.col("book_id").alias("id")), LEAST).select(F.col("id").alias("book_id"), "ref")
    return numbered(books.join(refs, "book_id"), F.desc("active"), F.asc("title"), F.asc("book_id"))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Rows with ``place``, their number from 1 in this order, by counts of the sorted partitions before them."""
    spark = rows.sparkSession
    # stored, since a sort that is run again may draw its ranges elsewhere
    placed = stored(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "numbered")
    # the numbers of rows by partition are as few as the partitions
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + inside + 1).drop("_part", "_id", "_before")


def parsed(selectors: DataFrame) -> DataFrame:
    """(selector_id, kind, wanted, key): what each selector asks for."""
    target = F.trim("selector")
    ref = F.regexp_extract(target, r"(?i)^B-([a-f0-9]{1,64})$", 1)
    titled = F.lower(target).startswith("title:")
    kind = F.when(target.rlike("(?i)^B-"), F.when(ref != "", "ref").otherwise("invalid")).when(target == "", "invalid").when(titled, "title").otherwise("auto")
    key = F.when(titled, title_key(F.trim(F.substr(target, F.lit(7))))).otherwise(title_key(target))
    return selectors.select("selector_id", kind.alias("kind"), F.when(kind == "ref", F.lower(ref)).otherwise(key).alias("key"))


def resolved(selectors: DataFrame, books: DataFrame) -> DataFrame:
    """(selector_id, status, book_id): found, ambiguous, missing or invalid; the book where there is one only.

    References meet by equality: each book is listed under its prefixes of the lengths that are asked for. Books are counted
    by prefix and by title before they meet selectors, so no list of all selectors' books is made.
    """
    asked = parsed(selectors)
    by_ref = asked.where("kind in ('ref', 'auto') and key rlike '^[a-f0-9]{1,64}$'").select("selector_id", F.col("key").alias("prefix"))
    lengths = by_ref.select(F.length("prefix").alias("length")).distinct()  # 64 at most
    prefixes = books.select("book_id").join(F.broadcast(lengths)).select("book_id", F.expr("left(book_id, length)").alias("prefix"))
    counted = [F.count(F.lit(1)).alias("n"), F.min("book_id").alias("book_id")]
    by_prefix = prefixes.join(by_ref.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(*counted)
    refs = by_ref.join(by_prefix, "prefix").select("selector_id", "n", "book_id", F.lit(0).alias("by"))
    by_title = asked.where("kind in ('title', 'auto')").select("selector_id", "key")
    # a title's key is made once, for all its books
    titled = books.groupBy("title").agg(*counted).select(title_key(F.col("title")).alias("key"), "n", "book_id")
    by_key = titled.groupBy("key").agg(F.sum("n").alias("n"), F.min("book_id").alias("book_id"))
    titles = by_title.join(by_key, "key").select("selector_id", "n", "book_id", F.lit(1).alias("by"))
    found = refs.unionByName(titles).groupBy("selector_id", "by").agg(F.sum("n").alias("n"), F.min("book_id").alias("book_id"))
    best = found.groupBy("selector_id").agg(F.min_by(F.struct("n", "book_id"), "by").alias("b"))
    n = F.coalesce("b.n", F.lit(0))
    status = F.when(F.col("kind") == "invalid", "invalid").when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous")
    return asked.join(best, "selector_id", "left").select("selector_id", status.alias("status"), F.when(status == "found", F.col("b.book_id")).alias("book_id"))
