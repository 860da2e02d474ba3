"""Tumbling windows by position, running budgets, contiguity, identity and integrity checks, catalogue joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import utf16_length

LINES, MAX_LINE_ELEMENT = 20, 30_000


def refused_texts(documents: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(document_id, why) of texts that are no plain text or too large: a NUL, more than ``most`` code units, an element of more than MAX_LINE_ELEMENT."""
    length = utf16_length(F.coalesce("text", F.lit("")))
    own = documents.select("document_id", F.when(F.col("text").contains("\u0000"), "nul").when(length > most, "size").alias("why")).where("why is not null")
    long = line_elements(documents).where(utf16_length(F.col("text")) > MAX_LINE_ELEMENT).select("document_id", F.lit("element").alias("why")).distinct()
    return own.unionByName(long)


def line_elements(documents: DataFrame, size: int = LINES) -> DataFrame:
    """(document_id, pos, start, stop, text): runs of ``size`` lines with 1-based line numbers; no shuffle."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size))
    cut = documents.select("document_id", lines.alias("lines")).select("document_id", "lines", F.posexplode(starts).alias("pos", "at"))
    return cut.select(
        "document_id", "pos", (F.col("at") + 1).alias("start"), F.least(F.col("at") + size, F.size("lines")).alias("stop"),
        F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n").alias("text"),
    )


def batches(rows: DataFrame, partition: str, order: str, size: int) -> DataFrame:
    """Rows with ``batch``: the 0-based number of their run of ``size`` in order, within the partition."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1) / size).cast("int"))


def gaps(rows: DataFrame, partition: str, start: str, stop: Column) -> DataFrame:
    """Rows that do not begin where their predecessor ended (the first must begin at 0)."""
    before = F.lag(stop, 1, 0).over(Window.partitionBy(partition).orderBy(start))
    return rows.withColumn("expected", before).where(F.col(start) != F.col("expected"))


#: Numbers of an order that are summed up together.
STRETCH = 1 << 16


def running_total(rows: DataFrame, partition: str, order: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """Rows with ``running``: the sum of ``value`` up to each row, by a whole number ``order`` that is unique in a partition.

    Stretches of the order are summed up first, then the few sums, then the rows within their stretch: a partition with a
    third of all rows is many windows.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / stretch))
    sums = cut.groupBy(partition, "_stretch").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(partition).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select(F.col(partition).alias("_key"), F.col("_stretch").alias("_at"), before.alias("_base"))
    inside = F.sum(value).over(Window.partitionBy(partition, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    own = cut.withColumn("_inside", inside)
    same = F.col(partition).eqNullSafe(F.col("_key")) & F.col("_stretch").eqNullSafe(F.col("_at"))
    return own.join(bases, same).withColumn("running", F.col("_base") + F.coalesce("_inside", F.lit(0))).drop("_stretch", "_key", "_at", "_base", "_inside")


def within_budget(rows: DataFrame, partition: str, order: str, value: str, budget: int) -> DataFrame:
    """The same rows, unless a partition's sum exceeds the budget: then ``OverBudget``."""
    over = rows.groupBy(partition).agg(F.sum(value).alias("total")).where(F.col("total") > budget).limit(1).collect()
    if over:
        raise OverBudget(f"{over[0][partition]}: {over[0]['total']} is more than {budget}")
    return rows


class OverBudget(ValueError):
    pass


def repeated_ids(*ids: DataFrame) -> DataFrame:
    """Ids that occur more than once over all given (id) tables."""
    every = ids[0]
    for more in ids[1:]:
        every = every.unionByName(more)
    return every.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the last row by ``order``, by aggregation (a key with many rows is combined before the shuffle)."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last")).select(key, "last.*")


def unique_prefixes(ids: DataFrame, least: int = 20) -> DataFrame:
    """(id, ref): each hex id's shortest prefix of at least ``least`` characters that no other id has.

    In sorted order only the neighbours matter, so there is no self join; ids are dealt by as many of their first
    characters as a reference has at least (six at most).
    """
    part = ids.select("id", F.substring("id", 1, min(least, 6)).alias("head"))
    window = Window.partitionBy("head").orderBy("id")

    def shared(other: Column) -> Column:
        places = F.sequence(F.lit(1), F.length("id"))
        differs = F.filter(places, lambda i: F.substring(F.col("id"), i, F.lit(1)) != F.substring(other, i, F.lit(1)))
        return F.when(other.isNull(), F.lit(0)).otherwise(F.coalesce(F.element_at(differs, 1) - 1, F.length("id")))

    near = part.withColumn("before", F.lag("id").over(window)).withColumn("after", F.lead("id").over(window))
    length = F.greatest(F.lit(least), shared(F.col("before")) + 1, shared(F.col("after")) + 1)
    return near.select("id", F.concat(F.lit("B-"), F.substring(F.col("id"), F.lit(1), length)).alias("ref"))


def merged_books(direct: DataFrame, generated: DataFrame) -> DataFrame:
    """Full outer merge of (book_id, title, pages, active) by book_id: first title, most pages, either active."""
    a, b = direct.alias("a"), generated.alias("b")
    return a.join(b, "book_id", "full_outer").select(
        "book_id", F.coalesce("a.title", "b.title").alias("title"), F.greatest("a.pages", "b.pages").alias("pages"),
        (F.coalesce("a.active", F.lit(False)) | F.coalesce("b.active", F.lit(False))).alias("active"),
    )


def capped_links(hits: DataFrame, links: DataFrame, limit: int = 5) -> DataFrame:
    """Linked images in hit order: each image once at its first hit, the first ``limit`` of each query.

    hits: (query_id, element_id, rank); links: (element_id, image_id, image_pos).
    """
    linked = hits.join(links, "element_id").groupBy("query_id", "image_id").agg(F.min(F.struct("rank", "image_pos")).alias("first"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "image_id"))
    return linked.select("query_id", "image_id", order.alias("ord")).where(F.col("ord") <= limit)


def numbered_once(rows: DataFrame, key: str, index: str) -> DataFrame:
    """(key, n, whole): whether a key's rows are numbered 0 to n - 1, each number once."""
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(n.alias("n"), ((n == F.max(index) + 1) & (n == F.countDistinct(index)) & (F.min(index) == 0)).alias("whole"))
