"""Retrieval quality: first ranks, hit and reciprocal rank, locator overlap, recall, coverage, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, document_id, document_rank) by each document's first appearance in (query_id, document_id, rank)."""
    first = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    return first.select("query_id", "document_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "document_id")).alias("document_rank"))


def rank_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: first relevant rank, hit at k, reciprocal rank at k, recall at k (null without gold).

    hits: (query_id, document_id, rank, relevant); relevant: (query_id, relevant), how many documents are.
    """
    found = hits.where("relevant").where(F.col("rank") <= k)
    best = found.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.countDistinct("document_id").alias("found"))
    queries = hits.select("query_id").union(relevant.select("query_id")).distinct()
    return queries.join(best, "query_id", "left").join(relevant, "query_id", "left").select(
        "query_id", "first_rank", F.col("first_rank").isNotNull().alias("hit"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(ratio(F.coalesce("found", F.lit(0)), F.col("relevant")), 6).alias("recall"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """Null where the whole is zero or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def overlapping(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits (document_id, start, stop) with the gold spans (document_id, span_id, span_start, span_stop) they overlap.

    An equality on the document keeps it a hash or merge join; the range is its residual condition.
    """
    return hits.join(spans, (hits["document_id"] == spans["document_id"]) & (hits["start"] <= spans["span_stop"]) & (hits["stop"] >= spans["span_start"])).drop(spans["document_id"])


def nearest_rank(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, nearest_rank, n): the smallest value that at least ``share`` of a key's values do not exceed.

    Values are counted by ranges between approximate quantiles first; only the range that holds the wanted rank is put in
    order, so no task sorts a whole key.
    """
    own = rows.select(key, F.col(value).alias("v")).where("v is not null")
    cuts = own.groupBy(key).agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    ranged = own.join(F.broadcast(cuts), key)  # a row for each key
    ranged = ranged.select(key, "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))
    counts = ranged.groupBy(key, "range").agg(F.count(F.lit(1)).alias("n"))  # 64 a key at most
    window = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counts.select(key, "range", "n", before.alias("before"), F.sum("n").over(window).alias("total"))
    wanted = F.greatest(F.ceil(F.col("total") * share), F.lit(1))
    held = total.withColumn("wanted", wanted).where("before < wanted and wanted <= before + n").select(key, "range", (F.col("wanted") - F.col("before")).alias("nth"), "total")
    inside = ranged.join(F.broadcast(held), [key, "range"]).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("v")))
    found = inside.where("i = nth").select(key, F.col("v").alias("nearest_rank"), F.col("total").alias("n"))
    return rows.select(key).distinct().join(found, key, "left").select(key, "nearest_rank", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(requirements: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per answer: requirements nothing maps to, and mappings to no requirement.

    requirements: (answer_id, requirement_id); mapped: (answer_id, requirement_id), a row for each reference.
    """
    need = requirements.groupBy("answer_id").agg(F.collect_set("requirement_id").alias("need"))
    have = mapped.groupBy("answer_id").agg(F.collect_set("requirement_id").alias("have"))
    none = F.array().cast("array<bigint>")
    need_c, have_c = F.coalesce("need", none), F.coalesce("have", none)
    return need.join(have, "answer_id", "full_outer").select(
        "answer_id", F.size(F.array_except(need_c, have_c)).alias("uncovered"), F.size(F.array_except(have_c, need_c)).alias("dangling"),
        ((F.size(F.array_except(need_c, have_c)) == 0) & (F.size(need_c) > 0)).alias("answered"),
    )


def set_recall(shown: DataFrame, wanted: DataFrame, item: str) -> DataFrame:
    """(query_id, recall, precision) of sets of items; null where the set to be divided by is empty."""
    keys = ["query_id", item]
    both = shown.select(*keys).distinct().withColumn("s", F.lit(1)).join(wanted.select(*keys).distinct().withColumn("w", F.lit(1)), keys, "full_outer")
    per = both.groupBy("query_id").agg(F.sum(F.when(F.col("s") + F.col("w") == 2, 1).otherwise(0)).alias("both"), F.count("s").alias("s"), F.count("w").alias("w"))
    return per.select("query_id", F.round(ratio(F.col("both"), F.col("w")), 6).alias("recall"), F.round(ratio(F.col("both"), F.col("s")), 6).alias("precision"))


def locator_recall(hits: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank) of gold spans that one of a query's first ``k`` hits overlaps.

    hits: (query_id, document_id, start, stop, rank); spans: (query_id, document_id, span_id, span_start, span_stop).
    """
    h, s = hits.where(F.col("rank") <= k).alias("h"), spans.alias("s")
    same = (F.col("h.query_id") == F.col("s.query_id")) & (F.col("h.document_id") == F.col("s.document_id"))
    met = s.join(h, same & (F.col("start") <= F.col("span_stop")) & (F.col("stop") >= F.col("span_start")), "left")
    best = met.groupBy(F.col("s.query_id").alias("query_id"), F.col("s.document_id").alias("document_id"), "span_id").agg(F.min("rank").alias("r"))
    return best.groupBy("query_id").agg(F.round(ratio(F.count("r"), F.count(F.lit(1))), 6).alias("recall"), F.round(F.coalesce(1 / F.min("r"), F.lit(0.0)), 6).alias("reciprocal_rank"))
