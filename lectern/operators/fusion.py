"""Dense ranking, reciprocal-rank fusion, hints, reserved slots and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import tokenize
from lectern.functions.vectors import cosine
from lectern.operators.lexical import in_order
from lectern.sources.scratch import stored

RRF_K, DEPTH = 60, 50


def dense_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(element_id, score) with positive cosine; the query is a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("element_id", cosine(F.col("vector"), q).alias("score")).where("score > 0")


def missing_vectors(elements: DataFrame, vectors: DataFrame) -> DataFrame:
    """Elements without a vector: a hybrid search must refuse unless this is empty."""
    return elements.select("element_id").join(vectors.select("element_id"), "element_id", "left_anti")


def reciprocal_rank_fusion(lists: list[DataFrame], limit: int, places: int = 6) -> DataFrame:
    """(element_id, score, lexical_rank, dense_rank, rank) from ranked lists (element_id, rank) of at most DEPTH rows each.

    The lists are united and summed in one shuffle, in place of a full outer join.
    """
    names = ["lexical_rank", "dense_rank"][: len(lists)]
    parts = [d.where(F.col("rank") <= DEPTH).select("element_id", F.lit(n).alias("of"), "rank") for d, n in zip(lists, names)]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    fused = united.groupBy("element_id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), *[F.max(F.when(F.col("of") == n, F.col("rank"))).alias(n) for n in names])
    order = [F.desc("score"), in_order("element_id", fused)]
    best = fused.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("score", F.round("score", places))


def hint_scores(hints: DataFrame, links: DataFrame, query: str) -> DataFrame:
    """(element_id, score): the most distinct query terms that a hint on one of the element's images shares.

    hints: (image_id, description); links: (image_id, element_id).
    """
    terms = F.array_distinct(tokenize(F.lit(query)))
    scored = hints.select("image_id", F.size(F.array_intersect(terms, F.array_distinct(tokenize(F.col("description"))))).alias("score")).where("score > 0")
    return scored.join(links, "image_id").groupBy("element_id").agg(F.max("score").alias("score"))


def reserve_hints(ranked: DataFrame, hints: DataFrame, pool: int) -> DataFrame:
    """(element_id, ord, hint): up to ceil(pool / 3) hints come last; the ranked list loses them and gives up their slots.

    ranked: (element_id, rank); hints: (element_id, score).
    """
    slots = -(-pool // 3)
    kept = hints.orderBy(F.desc("score"), "element_id").limit(slots)
    kept = kept.select("element_id", F.row_number().over(Window.orderBy(F.desc("score"), "element_id")).alias("rank"))
    kept = stored(kept, "hints-kept")  # a third of the pool at most, used three times
    size = kept.agg(F.count(F.lit(1)).alias("held"))
    rest = ranked.join(kept, "element_id", "left_anti")
    rest = rest.withColumn("ord", F.row_number().over(Window.orderBy("rank"))).join(F.broadcast(size)).where(F.col("ord") <= pool - F.col("held"))
    both = rest.select("element_id", F.lit(0).alias("part"), F.col("ord").alias("rank")).unionByName(kept.select("element_id", F.lit(1).alias("part"), "rank"))
    return both.select("element_id", F.row_number().over(Window.orderBy("part", "rank")).alias("ord"), (F.col("part") == 1).alias("hint"))


def rerank(candidates: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """(element_id, ord): by reranker score, ties in their former order. Raises unless scores are a permutation."""
    joined = candidates.select("element_id", "rank").join(scores.select("element_id", F.col("score").alias("rerank_score")), "element_id", "full_outer")
    whole = F.assert_true(F.col("rank").isNotNull() & F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score"), F.lit("rerank scores must cover the candidates once each"))
    ordered = joined.where(whole.isNull()).select("element_id", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "rank")).alias("ord"))
    return ordered.where(F.col("ord") <= limit)


def book_lexical(query: str, text: Column) -> Column:
    """Share of the query's white-space terms (duplicates count) that the lower-cased text contains."""
    terms = F.array(*[F.lit(t) for t in query.lower().split()])
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))) / F.lit(max(1, len(query.split())))


def book_hybrid(query: str, text: Column, similarity: Column) -> Column:
    return book_lexical(query, text) + F.greatest(F.lit(0.0), F.coalesce(similarity, F.lit(0.0)))
