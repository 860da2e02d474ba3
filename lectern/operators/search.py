"""The whole search: ranked lists, fusion, reserved hints, reranking, linked images and evidence identities.

Every step after the two ranked lists holds a pool of at most a few dozen rows. A search without any hit raises
``NoEvidence``; a hybrid search over elements of which one has no vector raises ``Incomplete``, it never falls back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import identity
from lectern.functions.text import tokenize, utf16_length
from lectern.operators import fusion, lexical
from lectern.sources.scratch import stored

MAX_QUERY, MAX_LIMIT, POOL, IMAGES = 8000, 10, 30, 5


class NoEvidence(RuntimeError):
    pass


class Incomplete(RuntimeError):
    pass


def checked(query: str, limit: int) -> str:
    if not query.strip() or len(query.encode("utf-16-le")) // 2 > MAX_QUERY or not 1 <= limit <= MAX_LIMIT:
        raise ValueError("invalid search query or limit")
    return query


def embed(text: Column) -> Column:
    """A local embedder without a model, for tests and as an example of a provider: how many tokens have each length (modulo 16), and a constant."""
    lengths = F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda t: F.length(t) % 16)
    count = lambda own: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter(own, lambda n: n == i)).cast("double"))
    counts = F.element_at(F.transform(F.array(lengths), count), 1)  # tokens are made once, not for each length
    return F.concat(counts, F.array(F.lit(1.0)))


def embedded(elements: DataFrame, provider: Callable[[Column], Column] = embed) -> DataFrame:
    """(element_id, vector) by a provider, which maps a text column to a vector column (a Pandas UDF over batches, for models)."""
    return elements.select("element_id", provider(F.col("text")).alias("vector"))


def search(
    index: lexical.Index, elements: DataFrame, hints: DataFrame, links: DataFrame, query: str, limit: int = 10,
    vectors: DataFrame | None = None, query_vector: list[float] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Hits in their order: (element_id, ord, hint).

    elements: (element_id, text); hints: (image_id, description); links: (image_id, element_id); vectors: (element_id,
    vector). ``rerank`` maps the candidates (element_id, rank, text) to (element_id, score) for each of them.
    """
    spark = elements.sparkSession
    queries = spark.range(1).select(F.col("id").alias("query_id"), F.lit(checked(query, limit)).alias("text"))
    lists = [lexical.top(lexical.bm25(index, queries), fusion.DEPTH)]
    if vectors is not None:
        if fusion.missing_vectors(elements, vectors).limit(1).count():
            raise Incomplete("an element has no vector in this space; index it before a hybrid search")
        lists.append(lexical.top(fusion.dense_scores(vectors, query_vector), fusion.DEPTH))
    pool = POOL if rerank else limit
    fused = fusion.reciprocal_rank_fusion(lists, pool)
    hinted = fusion.hint_scores(hints, links, query)
    merged = fusion.reserve_hints(fused, hinted, pool)
    hits = stored(merged.select("element_id", F.col("ord").alias("rank"), F.col("hint")), "pool")  # a few dozen rows, found once
    if not hits.limit(1).count():
        raise NoEvidence("no relevant evidence found")
    if rerank:
        candidates = hits.join(elements.select("element_id", "text"), "element_id")
        order = fusion.rerank(hits, rerank(candidates), limit)
        return stored(order.join(hits.select("element_id", "hint"), "element_id"), "hits")
    return hits.select("element_id", F.col("rank").alias("ord"), "hint").where(F.col("ord") <= limit)


def linked_images(hits: DataFrame, links: DataFrame, cap: int = IMAGES) -> DataFrame:
    """(image_id, element_id, seq): images in hit order, each at its first hit; OCR images count towards the cap and pass it.

    links: (image_id, element_id, image_pos, ocr).
    """
    near = links.join(F.broadcast(hits.select("element_id", "ord")), "element_id")  # hits are at most MAX_LIMIT
    first = near.groupBy("image_id").agg(F.min_by(F.struct("ord", "image_pos", "element_id", "ocr"), F.struct("ord", "image_pos", "image_id")).alias("f")).select("image_id", "f.*")
    placed = first.withColumn("seq", F.row_number().over(Window.orderBy("ord", "image_pos", "image_id")))
    return placed.where((F.col("seq") <= cap) | F.col("ocr")).select("image_id", "element_id", "seq")


def bundle(hits: DataFrame, elements: DataFrame, images: DataFrame, source: str) -> DataFrame:
    """Evidence rows (kind, ord, id, element_id, text_hash, start, stop) of a search's hits and their images."""
    own = elements.select("element_id", "text").join(F.broadcast(hits.select("element_id", "ord")), "element_id")
    text = F.coalesce("text", F.lit(""))
    key = lambda c: F.col(c).cast("string")
    texts = own.select(F.lit("text").alias("kind"), "ord", identity.text_id(F.lit(source), key("element_id")).alias("id"), "element_id", F.sha2(text, 256).alias("text_hash"), F.lit(0).alias("start"), utf16_length(text).alias("stop"))
    none = F.lit(None)
    figures = images.select(F.lit("figure").alias("kind"), F.col("seq").alias("ord"), identity.figure_id(F.lit(source), key("image_id")).alias("id"), "element_id", none.cast("string").alias("text_hash"), none.cast("int").alias("start"), none.cast("int").alias("stop"))
    return texts.unionByName(figures)


def answer_context(evidence: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """(occurrence_id, linked_text_ids): for each figure of a bundle the texts of the bundle that it illustrates.

    links: (image_id, element_id). A figure whose element is not in the bundle has no text.
    """
    figure = links.select(identity.figure_id(F.lit(source), F.col("image_id").cast("string")).alias("id"), F.col("element_id").alias("linked"))
    figures = evidence.where("kind = 'figure'").select("id").join(figure, "id", "left")
    texts = evidence.where("kind = 'text'").select(F.col("element_id").alias("linked"), F.col("id").alias("text_id"))
    return figures.join(texts, "linked", "left").groupBy(F.col("id").alias("occurrence_id")).agg(F.array_sort(F.collect_set("text_id")).alias("linked_text_ids"))
