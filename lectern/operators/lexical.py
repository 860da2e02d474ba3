"""Lexical ranking: a stored index of postings, corpus statistics, BM25 for one query or many.

Texts are tokenised once, when a snapshot is indexed: postings go into a table whose files are in order of terms, so that a
query reads the row groups of its own terms (the filter on ``term`` reaches the scan), and lengths are summed up in a table of
one row; a third table has each term with its document frequency, the number of its postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokenize
from lectern.sources.scratch import stored

K1, B = 1.2, 0.75


def tokenized(elements: DataFrame, key: str = "element_id", text: str = "text") -> DataFrame:
    return elements.select(F.col(key).alias("element_id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, element_id, tf, len); counted inside the row's task, as an element's tokens are one row."""
    exploded = tokens.select("element_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return exploded.groupBy("term", "element_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n, avg_len (1 where it would be 0)."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nullif(F.avg(F.size("tokens")), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.select("element_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    postings: DataFrame  # term, element_id, tf, len
    stats: DataFrame  # n, avg_len
    terms: DataFrame | None = None  # term, df; counted where it is not given

    def __post_init__(self) -> None:
        if self.terms is None:
            self.terms = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Bytes of a row group of postings, of which each file has several.
ROW_GROUP = 2 << 20

#: Terms of a query that are put into the scan's filter; longer queries (and batches) join them.
LITERALS = 200


def build(elements: DataFrame, folder: str) -> None:
    """Index (element_id, text) rows into ``folder``. A row without tokens counts for the statistics and has no posting."""
    tokens = tokenized(elements)
    sized = tokens.select("element_id", "tokens", F.size("tokens").alias("len"))
    rows = sized.select("element_id", "len", F.explode_outer("tokens").alias("term")).groupBy("term", "element_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    # as they were counted, dealt by term and element: no second exchange of all postings, and no task has a frequent term alone
    rows.sortWithinPartitions("term").write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{folder}/postings")
    spark = elements.sparkSession
    # every element has one posting at least, were it that of no term; it carries the length once
    own = spark.read.parquet(f"{folder}/postings").groupBy("element_id").agg(F.max("len").alias("len"))
    average = F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0))
    own.agg(F.count(F.lit(1)).alias("n"), average.alias("avg_len")).write.parquet(f"{folder}/stats")
    terms = spark.read.parquet(f"{folder}/postings").where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")


def opened(spark, folder: str) -> Index:
    postings, stats, terms = (spark.read.parquet(f"{folder}/{name}") for name in ("postings", "stats", "terms"))
    return Index(postings.where("term is not null"), stats, terms)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


#: Parts of a score are whole multiples of one by this, so their sum does not depend on their order.
UNITS = 1e12
#: Of a batch: pairs of query and term that go to all tasks at most, and parts of scores that a task adds up.
BROADCAST, TASK_ROWS = 500_000, 4_000_000


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, element_id, score) of every element that has a query term. ``queries``: (query_id, text).

    Equal elements have equal scores to the last bit, whatever the order in which their parts are added. With many queries,
    postings come together by element, each once, before they meet the queries that have their term: what is shuffled grows
    with the postings, not with the pairs of queries and elements, and the pairs stay where they are made.
    """
    terms = query_terms(queries).distinct()
    few = [r["term"] for r in terms.select("term").distinct().limit(LITERALS + 1).collect()]
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    units = F.round(part * UNITS).cast("long").alias("units")
    if len(few) <= LITERALS:
        own, df = (t.where(F.col("term").isin(few)) for t in (index.postings, index.terms))
        # idf goes to the terms' side, which is as small as the queries
        weights = terms.join(df, "term").join(F.broadcast(index.stats))
        met = own.join(weights, "term").select("query_id", "element_id", units)
    else:
        asked = terms.groupBy("term").agg(F.collect_list(F.struct("query_id")).alias("queries"))  # structs, as null ids count too
        numbered = asked.join(index.terms, "term").join(F.broadcast(index.stats)).withColumn("number", F.monotonically_increasing_id())
        weights = stored(numbered, "weights")
        many = F.size("queries").cast("long")
        size = weights.agg(F.sum(many).alias("queries"), F.sum(F.col("df") * many).alias("rows")).first()
        # the terms of the queries at hand go to all tasks unless they are many; beyond that the joins are Spark's choice
        told = F.broadcast if (size["queries"] or 0) <= BROADCAST else lambda rows: rows
        parts = index.postings.join(told(weights.drop("queries")), "term").select("element_id", "number", units)
        dealt = parts.repartition(max(1, -(-(size["rows"] or 0) // TASK_ROWS)), "element_id")
        met = dealt.join(told(weights.select("number", "queries")), "number").select("element_id", "units", F.inline("queries"))
    return met.groupBy("query_id", "element_id").agg((F.sum("units") / F.lit(UNITS)).alias("score"))


def in_order(column: str, rows: DataFrame) -> Column:
    """Ids compare as numbers, or, as strings, by Unicode collation."""
    return F.collate(F.col(column), "UNICODE") if rows.schema[column].dataType.typeName() == "string" else F.col(column)


def top(scored: DataFrame, limit: int, *partition: str, places: int = 6) -> DataFrame:
    """The best ``limit`` rows (of each partition) by score, then element_id, with their 1-based rank; scores are rounded afterwards."""
    from pyspark.sql import Window

    order = [F.desc("score"), in_order("element_id", scored)]
    window = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    if not partition:  # a top-k without a group needs no single task
        scored = scored.orderBy(*order).limit(limit)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit).withColumn("score", F.round("score", places))
