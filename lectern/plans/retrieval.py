"""Queries over stored vectors and hints, and the whole search.

Beside the mapping of ``catalogue``: every element has one image of its number, which also illustrates the next element;
images of French texts count as OCR; a benchmark item is a hint on the image of its number. Vectors come from the local
embedder of ``operators.search``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import identity
from lectern.operators import rules, search
from lectern.sources.retrieval_store import HintStore, VectorStore
from lectern.sources.scratch import scratch as _scratch

from .catalogue import BM25, ONE, QUERY, TOK, elements, index, once, query, read

SPACE = ("local", "length-16", 17)
EMBED = f"list_append(list_transform(range(16), lambda i: len(list_filter({TOK}, lambda x: len(x) % 16 = i))::DOUBLE), 1)"
SEARCH = rf"""
e AS (SELECT doc_id AS element_id, coalesce(text, '') AS text, {EMBED} AS v FROM documents),
qv AS (SELECT {EMBED} AS v FROM {ONE}),
dense AS (SELECT element_id, list_cosine_similarity(e.v, qv.v) AS score FROM e, qv WHERE list_cosine_similarity(e.v, qv.v) > 0),
lex AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM s QUALIFY rank <= 50),
den AS (SELECT element_id, row_number() OVER (ORDER BY round(score, 12) DESC, element_id) AS rank FROM dense QUALIFY rank <= 50),
rrf AS (SELECT element_id, coalesce(1 / (60 + l.rank), 0) + coalesce(1 / (60 + d.rank), 0) AS score FROM lex l FULL JOIN den d USING (element_id)),
links AS (SELECT doc_id AS image_id, unnest([doc_id, doc_id + 1]) AS element_id, lang IS NOT DISTINCT FROM 'fr' AS ocr FROM documents),
qt AS (SELECT list_distinct(regexp_extract_all(lower('{QUERY}'), '[\p{{L}}\p{{N}}_]+')) AS t),
hs AS (SELECT element_id, max(len(list_intersect(t, list_distinct({TOK})))) AS score FROM benchmark JOIN links ON image_id = item_id, qt WHERE len(list_intersect(t, list_distinct({TOK}))) > 0 GROUP BY 1),
ranked AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM rrf QUALIFY rank <= 30),
kept AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM hs QUALIFY rank <= 10),
rest AS (SELECT element_id, row_number() OVER (ORDER BY rank) AS place FROM ranked WHERE element_id NOT IN (SELECT element_id FROM kept) QUALIFY place <= 30 - (SELECT count(*) FROM kept)),
pool AS (SELECT element_id, row_number() OVER (ORDER BY part, place) AS rank, part = 1 AS hint FROM (SELECT 0 AS part, * FROM rest UNION ALL SELECT 1, element_id, rank FROM kept)),
hits AS (SELECT element_id, row_number() OVER (ORDER BY length(text) % 1000 DESC, rank) AS ord, hint FROM pool JOIN e USING (element_id) QUALIFY ord <= 10),
firsts AS (SELECT image_id, min_by((ord, element_id, ocr), (ord, image_id)) AS f FROM links JOIN hits USING (element_id) GROUP BY 1),
figures AS (SELECT image_id, f[2] AS element_id, f[3] AS ocr, row_number() OVER (ORDER BY f[1], image_id) AS seq FROM firsts),
bundle AS (SELECT 'text' AS kind, ord, 'text_' || sha256('corpus' || element_id::VARCHAR) AS id, element_id, sha256(text) AS text_hash, 0 AS start, length(text) AS stop FROM hits JOIN e USING (element_id)
  UNION ALL SELECT 'figure', seq, 'figure_' || sha256('corpus' || image_id::VARCHAR), element_id, '', 0, 0 FROM figures WHERE seq <= 5 OR ocr)"""


def links(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("element_id"), F.lit(0).alias("image_pos"), F.col("lang").eqNullSafe("fr").alias("ocr"))


def hints(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("image_id"), F.col("text").alias("description"))


def vectors(spark, sf):
    """The elements' vectors, stored by the first query of a session that needs them."""
    return spark.read.parquet(once(spark, sf, "local-vectors", lambda folder: search.embedded(elements(spark, sf)).write.parquet(folder)))


def _hits(spark, sf):
    own = elements(spark, sf)
    query_vector = spark.range(1).select(search.embed(F.lit(QUERY))).first()[0]
    score = lambda candidates: candidates.select("element_id", (F.length(F.coalesce("text", F.lit(""))) % 1000).cast("double").alias("score"))
    return search.search(index(spark, sf), own, hints(spark, sf), links(spark, sf), QUERY, 10, vectors(spark, sf), query_vector, score)


@query(f"WITH {BM25 % ONE}, {SEARCH} SELECT element_id, ord, hint FROM hits")
def hybrid_search(spark, sf):
    return _hits(spark, sf)


def _bundle(spark, sf):
    hits = _hits(spark, sf)
    return search.bundle(hits, elements(spark, sf), search.linked_images(hits, links(spark, sf)), "corpus")


@query(f"WITH {BM25 % ONE}, {SEARCH} SELECT * FROM bundle")
def evidence_bundle(spark, sf):
    return _bundle(spark, sf).fillna("", ["text_hash"]).fillna(0, ["start", "stop"])


@query(f"""WITH {BM25 % ONE}, {SEARCH} SELECT f.id AS occurrence_id, array_to_string(list_sort(list(DISTINCT t.id) FILTER (t.id IS NOT NULL)), ',') AS linked_text_ids
FROM bundle f LEFT JOIN links ON f.id = 'figure_' || sha256('corpus' || image_id::VARCHAR) LEFT JOIN bundle t ON t.kind = 'text' AND t.element_id = links.element_id WHERE f.kind = 'figure' GROUP BY 1""")
def answer_context(spark, sf):
    found = search.answer_context(_bundle(spark, sf), links(spark, sf), "corpus")
    return found.select("occurrence_id", F.array_join("linked_text_ids", ",").alias("linked_text_ids"))


def space_key():
    return identity.space_key(*map(F.lit, SPACE))


def _revisions(spark, sf):
    own = read(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("element_id"), "text", "lang")
    return own.where("document_id is not null").withColumn("revision", F.sha2("document_id", 256))


@query(f"SELECT source AS document_id, doc_id::VARCHAR AS element_id, len({EMBED}) AS dimension, round(list_sum({EMBED}), 6) AS total FROM documents WHERE source IS NOT NULL AND lang IS DISTINCT FROM 'de'")
def saved_vectors(spark, sf):
    """Vectors of all but German elements are saved, those of English ones twice; what is read back."""
    store, own = VectorStore(spark, _scratch(spark, "vectors")), _revisions(spark, sf)
    active, key = own.select("document_id", "revision").distinct(), spark.range(1).select(space_key()).first()[0]
    rows = own.where(~F.col("lang").eqNullSafe("de")).select("document_id", "revision", "element_id", search.embed(F.col("text")).alias("vector"), "lang")
    doubled = rows.where("lang = 'en'").withColumn("vector", F.transform("vector", lambda x: x * 2))
    store.save(doubled.drop("lang"), key, SPACE[2], active, 1)
    store.save(rows.drop("lang"), key, SPACE[2], active, 2)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return store.read(key).select("document_id", "element_id", F.size("vector").alias("dimension"), F.round(total, 6).alias("total"))


@query("SELECT source AS document_id, count(*) AS missing, (count(*) + 15) // 16 AS batches FROM documents WHERE source IS NOT NULL AND lang = 'de' GROUP BY source")
def index_coverage(spark, sf):
    """What is left to be indexed, by document, and in how many batches of 16; after them nothing is."""
    store, own = VectorStore(spark, _scratch(spark, "vectors")), _revisions(spark, sf)
    active, key = own.select("document_id", "revision").distinct(), spark.range(1).select(space_key()).first()[0]
    vector = search.embed(F.col("text")).alias("vector")
    keys = ["document_id", "revision", "element_id"]
    store.save(own.where(~F.col("lang").eqNullSafe("de")).select(*keys, vector), key, SPACE[2], active, 1)
    missing = store.missing(own, key)
    left = missing.groupBy("document_id").agg(F.count(F.lit(1)).alias("missing"))
    return left.select("document_id", "missing", F.ceil(F.col("missing") / 16).alias("batches"))


def _bound(spark, sf):
    """Hints on the images of elements: benchmark items under the image of their number."""
    images = _revisions(spark, sf).select("document_id", "revision", F.sha2("document_id", 256).alias("source_hash"), F.col("element_id").alias("image_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob_hash"))
    own = hints(spark, sf).select(F.col("image_id").cast("string").alias("image_id"), "description")
    return own.join(images, "image_id").withColumn("model_fingerprint", F.sha2(F.lit("model"), 256)).withColumn("prompt_fingerprint", F.sha2(F.lit("prompt"), 256))


HINT = """(SELECT 'hint_' || sha256('["vision-hint-v1","' || array_to_string([source, sha256(source), sha256(source), doc_id::VARCHAR, sha256(coalesce(d.text, '')), sha256('model'), sha256('prompt')], '","') || '"]') AS id,
  source AS document_id, doc_id::VARCHAR AS image_id, sha256(b.text) AS description_hash FROM benchmark b JOIN documents d ON doc_id = item_id WHERE source IS NOT NULL)"""


@query(f"SELECT * FROM {HINT}")
def hint_store(spark, sf):
    """Hints are saved twice, which adds them once."""
    store = HintStore(spark, _scratch(spark, "hints"))
    new = store.save(_bound(spark, sf))
    if store.save(_bound(spark, sf)) or not new:
        raise RuntimeError("saving hints again changed the store")
    return store.read().select("id", "document_id", "image_id", "description_hash")


@query(f"SELECT id FROM {HINT} h JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'en') a ON h.document_id = a.source")
def active_hints(spark, sf):
    """Hints of documents whose revision is active: those with an English element."""
    store = HintStore(spark, _scratch(spark, "hints"))
    store.save(_bound(spark, sf))
    return store.active(_revisions(spark, sf).where("lang = 'en'").select("document_id", "revision").distinct()).select("id")


@query(r"""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(text) > 100 THEN 'long_description' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_description' END, CASE WHEN d.doc_id IS NULL THEN 'unknown_image' END], lambda x: x IS NOT NULL)) AS code
FROM (SELECT doc_id + 3 AS image_id, text FROM documents) h LEFT JOIN (SELECT doc_id FROM documents) d ON d.doc_id = h.image_id) GROUP BY code""")
def hint_violations(spark, sf):
    """Texts as hints on the third image after them: bindings and sizes (here 100 signs at most)."""
    docs = read(spark, sf, "documents")
    own = docs.select((F.col("doc_id") + 3).alias("image_id"), F.col("text").alias("description"))
    images = docs.select(F.col("doc_id").alias("image_id"))
    return rules.counted(rules.hint_rules(own, images, most=100))
