"""Queries over generations of vectors, and over one epoch of catalogue, vectors and hints.

A source of ``documents`` is a book, a document a window of it (and its page), the document's retrieval chunks its
elements. In a library a source is a document, whose elements are the texts of that source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.embedding import Lengths, embedded
from lectern.sources.generation_store import GenerationStore
from lectern.sources.library import Library
from lectern.sources.retrieval_store import VectorStore
from lectern.sources.scratch import scratch as _scratch
from lectern.sources.scratch import stored

from .catalogue import QUERY, query, read
from .retrieval import EMBED, HINT, _bound, _revisions
from .streams import CHUNKS, SPACE, chunks, total

WORDS = sorted(QUERY.split())
#: el with its book; batches of 4 in each document, numbered over the book.
BOOKS = f"""{CHUNKS}, k AS (SELECT source AS book_id, document_id AS page, pos, text FROM el JOIN (SELECT doc_id, source FROM documents) ON doc_id = document_id WHERE source IS NOT NULL),
n AS (SELECT book_id, page, (max(pos) + 4) // 4 AS n FROM k GROUP BY ALL), b AS (SELECT book_id, sum(n)::BIGINT AS planned FROM n GROUP BY 1)"""


def book_elements(spark, sf):
    source = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("book_id")).where("book_id is not null")
    own = chunks(spark, sf).join(source, "document_id")
    return stored(own.select("book_id", F.col("document_id").cast("long").alias("window_no"), "pos", F.col("document_id").cast("long").alias("page"), "text"), "books")


def _first_half():
    return F.pmod(F.octet_length(F.col("book_id")), F.lit(2)) == 0


def _shadow(spark, sf):
    """Generation one of all books, active; beside it two, of the books whose names have an even length."""
    elements, store = book_elements(spark, sf), GenerationStore(spark, _scratch(spark, "generations"))
    for generation, own in (("one", elements), ("two", elements.where(_first_half()))):
        store.reindex(generation, SPACE)
        store.resume(generation, own, SPACE, Lengths(SPACE), "0")
    requests = elements.select("book_id").distinct().select("book_id", F.lit("one").alias("generation"), F.lit(None).cast("string").alias("expected"), F.lit(0).alias("expected_epoch"))
    store.activate(requests, elements)
    return elements, store


@query(f"""{BOOKS} SELECT b.book_id, planned, CASE WHEN strlen(b.book_id) % 2 = 0 THEN planned ELSE 0 END AS stored, CASE WHEN strlen(b.book_id) % 2 = 0 THEN 0 ELSE planned END AS missing,
strlen(b.book_id) % 2 = 0 AS valid FROM b""")
def reindex(spark, sf):
    """The shadow generation against the books as they are."""
    elements, store = _shadow(spark, sf)
    return store.state("two", elements).select("book_id", "planned", "stored", "missing", "valid")


@query(f"""{BOOKS} SELECT book_id, CASE WHEN strlen(book_id) % 3 = 0 THEN 'moved' WHEN strlen(book_id) % 2 = 1 THEN 'not valid' ELSE 'taken' END AS outcome,
CASE WHEN strlen(book_id) % 3 <> 0 AND strlen(book_id) % 2 = 0 THEN 'two' ELSE 'one' END AS generation, CASE WHEN strlen(book_id) % 3 <> 0 AND strlen(book_id) % 2 = 0 THEN 2 ELSE 1 END AS epoch FROM b""")
def generation_activation(spark, sf):
    """The shadow generation is asked for, by every third name with an epoch that has passed; what is active then."""
    elements, store = _shadow(spark, sf)
    stale = F.octet_length("book_id") % 3 == 0
    requests = elements.select("book_id").distinct().select("book_id", F.lit("two").alias("generation"), F.lit("one").alias("expected"), F.when(stale, 0).otherwise(1).alias("expected_epoch"))
    done = store.activate(requests, elements).select("book_id", F.coalesce("why", F.lit("taken")).alias("outcome"))
    return done.join(store.pointers(), "book_id").select("book_id", "outcome", "generation", "epoch")


@query(f"""{BOOKS}, qv AS (SELECT {EMBED} AS q FROM (SELECT '{QUERY}' AS text)),
s AS (SELECT book_id, page, pos, round(len(list_filter({WORDS}, lambda t: contains(lower(text), t))) / {len(WORDS)} + greatest(0, list_cosine_similarity({EMBED}, q)), 12) AS score FROM k, qv),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, page, pos) AS rank FROM s WHERE score <> 0 QUALIFY rank <= 5)
SELECT book_id, CASE WHEN strlen(book_id) % 2 = 0 THEN 'two' ELSE 'one' END AS generation, page, pos, round(score, 6) AS score, rank FROM r""")
def generation_search(spark, sf):
    """The best five chunks of each book, in its active generation, after half of the books went over to the second one."""
    elements, store = _shadow(spark, sf)
    requests = elements.where(_first_half()).select("book_id").distinct()
    store.activate(requests.select("book_id", F.lit("two").alias("generation"), F.lit("one").alias("expected"), F.lit(1).alias("expected_epoch")), elements)
    hits = store.search(elements, QUERY, 5, SPACE, Lengths(SPACE))
    return hits.select("book_id", "generation", "page", "pos", F.round("score", 6).alias("score"), "rank")


def _embedded(spark, sf):
    rows = _revisions(spark, sf).where(F.length(F.coalesce("text", F.lit(""))) <= 32_768)
    return embedded(rows.select("document_id", "revision", "element_id", "text"), SPACE, Lengths(SPACE))


@query(f"SELECT doc_id::VARCHAR AS element_id, len({EMBED}) AS dimension, round(list_sum({EMBED}), 6) AS total FROM documents WHERE source = (SELECT min(source) FROM documents) AND length(coalesce(text, '')) <= 32768")
def document_vectors(spark, sf):
    """One document's vectors, from its bucket alone, after those of all documents were saved twice."""
    store, vectors = VectorStore(spark, _scratch(spark, "vectors")), _embedded(spark, sf)
    active = _revisions(spark, sf).select("document_id", "revision").distinct()
    doubled = vectors.withColumn("vector", F.transform("vector", lambda x: x * 2))
    for rows, epoch in ((doubled, 1), (vectors, 2)):
        store.save(rows, "lengths", SPACE.dimension, active, epoch)
    name, revision = active.agg(F.min_by(F.struct("document_id", "revision"), "document_id").alias("d")).select("d.*").first()
    return store.document("lengths", name, revision).select("element_id", F.size("vector").alias("dimension"), total())


@query(f"""WITH own AS (SELECT source, doc_id, length(coalesce(text, '')) <= 32768 AS fits FROM documents WHERE source IS NOT NULL), low AS (SELECT min(source) AS m FROM own), h AS (SELECT document_id FROM {HINT})
SELECT e AS epoch, (SELECT count(DISTINCT source) FROM own, low WHERE e <> 3 AND e <> 4 OR source <> m) AS documents, (SELECT count(*) FROM own, low WHERE e < 3 OR source <> m) AS elements,
(SELECT count(*) FROM own, low WHERE fits AND (e < 3 OR source <> m)) AS vectors, (SELECT count(*) FROM h, low WHERE e > 1 AND (e < 3 OR document_id <> m)) AS hints FROM range(1, 4) t(e)""")
def snapshot_at_epoch(spark, sf):
    """A publication with its vectors, hints, and the removal of the first document: all tables as of each of the three epochs."""
    library, rows = Library(spark, _scratch(spark, "library"), "document_id string, revision string, element_id string"), _revisions(spark, sf)
    library.catalogue.publish(rows.select("document_id", "revision", "element_id"), 0)
    library.dispatched(1, lambda: library.save_vectors(_embedded(spark, sf), "lengths", SPACE.dimension, 1))
    library.save_hints(_bound(spark, sf), 1)
    library.catalogue.remove(rows.agg(F.min("document_id").alias("document_id")), 2)
    out = None
    for epoch in (1, 2, 3):
        s = library.snapshot("lengths", epoch)
        parts = [("documents", s.documents), ("elements", s.elements), ("vectors", s.vectors), ("hints", s.hints)]
        row = spark.range(1).select(F.lit(epoch).cast("long").alias("epoch"))
        for name, table in parts:
            row = row.join(F.broadcast(table.agg(F.count(F.lit(1)).alias(name))))  # tables of one row
        out = row if out is None else out.unionByName(row)
    return out
