"""The registered queries and their SQL.

Tables stand for the data model thus: ``documents`` are elements (element_id = doc_id), ``embeddings`` their vectors
(vec_id = doc_id), ``benchmark`` a set of queries, ``labels`` the gold, ``conversations`` ordered turns, ``events``
revisions, ``orders`` and ``lineitem`` documents with linked images, ``pages`` HTML sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import chunking, evaluate, fusion, lexical, structure
from lectern.sources.catalogue_store import CatalogueStore
from lectern.sources.scratch import scratch as _scratch
from lectern.sources.scratch import stored
from lectern.streaming import ingest as ingestion

QUERY = "the thonou ent de la que"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def elements(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), "text")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.tokenized(elements(spark, sf))


_made: dict[tuple, str] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable[[str], None]) -> str:
    """A folder that ``make`` fills for a snapshot, in the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _made:
        folder = _scratch(spark, name)
        make(folder)
        _made[key] = folder
    return _made[key]


def index(spark: SparkSession, sf: str) -> lexical.Index:
    return lexical.opened(spark, once(spark, sf, "index", lambda folder: lexical.build(elements(spark, sf), folder)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("element_id"), V.doubles(F.col("embedding")).alias("vector"))


def one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUERY).alias("text"))


TOK = r"regexp_extract_all(lower(coalesce(text, '')), '\p{Han}+|[\p{L}\p{N}_]+')"
BM25 = rf"""
tok AS (SELECT doc_id AS element_id, {TOK} AS t FROM documents),
st AS (SELECT count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1) AS a FROM tok),
q AS (SELECT DISTINCT query_id, unnest({TOK}) AS term FROM %s),
x AS (SELECT element_id, len(t) AS l, unnest(t) AS term FROM tok),
tf AS (SELECT term, element_id, l, count(*) AS c FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
s AS (SELECT query_id, element_id, sum(round(ln(1 + (n - d + 0.5) / (d + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * l / a)) * 1e12)::BIGINT)::DOUBLE / 1e12 AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY query_id, element_id)"""
ONE = f"(SELECT 0 AS query_id, '{QUERY}' AS text)"
MANY = "(SELECT item_id AS query_id, text FROM benchmark)"
TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS rank FROM s)"
COS = """
q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
dense AS (SELECT vec_id AS element_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q0 WHERE list_cosine_similarity(embedding::DOUBLE[], q) > 0)"""


@query(rf"SELECT doc_id AS element_id, len({TOK}) AS n_tokens, len(list_distinct({TOK})) AS n_distinct FROM documents")
def tokenize_terms(spark, sf):
    return tokens(spark, sf).select("element_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


@query(rf"SELECT count(*) AS n, round(coalesce(nullif(avg(len({TOK})), 0), 1), 6) AS avg_len FROM documents")
def corpus_stats(spark, sf):
    return lexical.corpus_stats(tokens(spark, sf)).select("n", F.round("avg_len", 6).alias("avg_len"))


@query(rf"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    return lexical.document_frequency(tokens(spark, sf))


@query(rf"SELECT term, element_id, count(*) AS tf, any_value(l) AS len FROM (SELECT doc_id AS element_id, len({TOK}) AS l, unnest({TOK}) AS term FROM documents) GROUP BY term, element_id")
def postings_index(spark, sf):
    return lexical.postings(tokens(spark, sf))


@query(f"WITH {BM25 % ONE}, {TOP} SELECT query_id, element_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf):
    return lexical.top(lexical.bm25(index(spark, sf), one_query(spark)), 10)


def _batch(spark, sf):
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.top(lexical.bm25(index(spark, sf), queries), 10, "query_id")


@query(f"WITH {BM25 % MANY}, {TOP} SELECT query_id, element_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_batch(spark, sf):
    return _batch(spark, sf)


def _query_vector(spark, sf) -> list[float]:
    return vectors(spark, sf).where("element_id = 0").first()["vector"]


@query(f"WITH {COS} SELECT element_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM dense QUALIFY rank <= 10")
def cosine_topk(spark, sf):
    return lexical.top(fusion.dense_scores(vectors(spark, sf), _query_vector(spark, sf)), 10)


RRF = f"""
lex AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM s QUALIFY rank <= 50),
den AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM dense QUALIFY rank <= 50),
rrf AS (SELECT element_id, coalesce(1 / (60 + l.rank), 0) + coalesce(1 / (60 + d.rank), 0) AS score, l.rank AS lexical_rank, d.rank AS dense_rank FROM lex l FULL JOIN den d USING (element_id))"""


def _rrf(spark, sf, limit):
    lex = lexical.top(lexical.bm25(index(spark, sf), one_query(spark)), fusion.DEPTH)
    den = lexical.top(fusion.dense_scores(vectors(spark, sf), _query_vector(spark, sf)), fusion.DEPTH)
    return fusion.reciprocal_rank_fusion([lex, den], limit)


@query(f"WITH {BM25 % ONE}, {COS}, {RRF} SELECT element_id, round(score, 6) AS score, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(dense_rank, 0) AS dense_rank FROM rrf ORDER BY score DESC, element_id LIMIT 30")
def rrf_fuse(spark, sf):
    return _rrf(spark, sf, 30).drop("rank").fillna(0, ["lexical_rank", "dense_rank"])


@query("""SELECT doc_id AS element_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def coverage_antijoin(spark, sf):
    return fusion.missing_vectors(elements(spark, sf), vectors(spark, sf))


HINTS = rf"""
qt AS (SELECT list_distinct(regexp_extract_all(lower('{QUERY}'), '[\p{{L}}\p{{N}}_]+')) AS t),
hs AS (SELECT item_id % 97 AS element_id, max(len(list_intersect(t, list_distinct({TOK})))) AS score FROM benchmark, qt WHERE len(list_intersect(t, list_distinct({TOK}))) > 0 GROUP BY 1)"""


def _hints(spark, sf):
    own = read(spark, sf, "benchmark")
    return fusion.hint_scores(own.select(F.col("item_id").alias("image_id"), F.col("text").alias("description")), own.select(F.col("item_id").alias("image_id"), (F.col("item_id") % 97).alias("element_id")), QUERY)


@query(f"WITH {HINTS} SELECT * FROM hs")
def hint_overlap(spark, sf):
    return _hints(spark, sf)


@query(f"""WITH {BM25 % ONE}, {COS}, {RRF}, {HINTS},
ranked AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM rrf QUALIFY rank <= 30),
kept AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM hs QUALIFY rank <= 10),
rest AS (SELECT element_id, row_number() OVER (ORDER BY rank) AS place FROM ranked WHERE element_id NOT IN (SELECT element_id FROM kept) QUALIFY place <= 30 - (SELECT count(*) FROM kept))
SELECT element_id, row_number() OVER (ORDER BY part, place) AS ord FROM (SELECT 0 AS part, * FROM rest UNION ALL SELECT 1, element_id, rank FROM kept)""")
def hint_reserve(spark, sf):
    fused = _rrf(spark, sf, 30)
    return fusion.reserve_hints(fused, _hints(spark, sf), 30).drop("hint")


@query(f"""WITH {BM25 % ONE}, c AS (SELECT element_id, row_number() OVER (ORDER BY score DESC, element_id) AS rank FROM s QUALIFY rank <= 30)
SELECT element_id, row_number() OVER (ORDER BY n_chars % 1000 DESC, rank) AS ord FROM c JOIN documents ON doc_id = element_id QUALIFY ord <= 10""")
def rerank_order(spark, sf):
    candidates = lexical.top(lexical.bm25(index(spark, sf), one_query(spark)), 30)
    scores = read(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), (F.col("n_chars") % 1000).cast("double").alias("score"))
    return fusion.rerank(candidates, scores.join(candidates.select("element_id"), "element_id", "left_semi"), 10)


@query("""SELECT element_id, score FROM (SELECT doc_id AS element_id, round(len(list_filter(['the','thonou','ent','de','la','que'], lambda t: contains(lower(text), t))) / 6, 6) AS score FROM documents) WHERE score <> 0 ORDER BY score DESC, element_id LIMIT 10""")
def book_lexical(spark, sf):
    scored = elements(spark, sf).select("element_id", F.round(fusion.book_lexical(QUERY, F.col("text")), 6).alias("score"))
    return scored.where("score <> 0").orderBy(F.desc("score"), "element_id").limit(10)


@query("""SELECT element_id, score FROM (SELECT doc_id AS element_id, round(len(list_filter(['the','thonou','ent','de','la','que'], lambda t: contains(lower(text), t))) / 6
  + greatest(0, coalesce(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0)), 6) AS score
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id) WHERE score <> 0 ORDER BY score DESC, element_id LIMIT 10""")
def book_hybrid(spark, sf):
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf)])
    joined = elements(spark, sf).join(vectors(spark, sf), "element_id", "left")
    scored = joined.select("element_id", F.round(fusion.book_hybrid(QUERY, F.col("text"), V.cosine(F.col("vector"), q)), 6).alias("score"))
    return scored.where("score <> 0").orderBy(F.desc("score"), "element_id").limit(10)


LINES = """lines AS (SELECT doc_id AS document_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
el AS (SELECT document_id, (i // 20)::INT AS pos, (i + 1)::INT AS start, least(i + 20, len(l))::INT AS stop, array_to_string(list_slice(l, i + 1, i + 20), chr(10)) AS text FROM (SELECT document_id, l, unnest(range(0, len(l), 20)) AS i FROM lines))"""


@query(f"WITH {LINES} SELECT document_id, pos, start, stop, sha256(text) AS text_hash, strlen(text) AS n_bytes FROM el")
def line_windows20(spark, sf):
    cut = structure.line_elements(read(spark, sf, "documents").withColumnRenamed("doc_id", "document_id"))
    return cut.select("document_id", "pos", "start", "stop", F.sha2("text", 256).alias("text_hash"), F.octet_length("text").alias("n_bytes"))


@query("SELECT conv_id, batch, count(*) AS n, min(turn) AS first_turn FROM (SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4)::INT AS batch FROM conversations) GROUP BY ALL")
def batch_ordinals(spark, sf):
    return structure.batches(read(spark, sf, "conversations"), "conv_id", "turn", 4).groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


@query("SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, lag(turn + 1, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations) WHERE turn <> expected")
def contiguity_check(spark, sf):
    return structure.gaps(read(spark, sf, "conversations"), "conv_id", "turn", F.col("turn") + 1).select("conv_id", "turn", F.col("expected").cast("long").alias("expected"))


@query("SELECT source, count(*) AS within, max(running) AS used FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 50000 GROUP BY source")
def running_budget(spark, sf):
    total = structure.running_total(read(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")
    return total.where("running <= 50000").groupBy("source").agg(F.count(F.lit(1)).alias("within"), F.max("running").alias("used"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_revision(spark, sf):
    return structure.latest(read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id").drop("ts")


@query("""SELECT e.user_id, count(*) AS n, round(sum(value), 4) AS total FROM events e JOIN (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) a USING (user_id, event_type) GROUP BY e.user_id""")
def active_join(spark, sf):
    events = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    active = structure.latest(events, "user_id", "ts", "event_id").select("user_id", "event_type")
    return events.join(active, ["user_id", "event_type"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderkey AS document_id, count(*) AS images, count(DISTINCT l_partkey) AS blobs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def image_link_join(spark, sf):
    joined = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_orderkey").alias("document_id")).agg(F.count(F.lit(1)).alias("images"), F.countDistinct("l_partkey").alias("blobs"))


@query("""WITH hits AS (SELECT o_custkey AS query_id, o_orderkey AS element_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT query_id, l_partkey AS image_id, min((rank, l_linenumber)) AS first FROM hits JOIN lineitem ON l_orderkey = element_id GROUP BY 1, 2)
SELECT query_id, image_id, row_number() OVER (PARTITION BY query_id ORDER BY first, image_id) AS ord FROM f QUALIFY ord <= 5""")
def image_cap(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("element_id"), "o_totalprice")
    hits = orders.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "element_id")))
    links = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_partkey").alias("image_id"), F.col("l_linenumber").alias("image_pos"))
    return structure.capped_links(hits, links)


@query("""WITH h AS (SELECT user_id AS query_id, event_type AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
f AS (SELECT query_id, document_id, min(rank) AS first FROM h GROUP BY 1, 2)
SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY first, document_id) AS document_rank FROM f""")
def doc_first_rank(spark, sf):
    hits = read(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("document_id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    return evaluate.document_ranks(hits)


GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS document_id FROM benchmark JOIN labels ON quality = 1 AND doc_id % 40 = item_id % 40)"


def _judged(spark, sf):
    """The hits of all items with whether they are relevant, and how many documents are relevant to each item.

    A good document is relevant to the items of its rest by 40: hits meet documents by their number, and relevant ones
    are counted by rest, so no list of all relevant pairs is made.
    """
    # stored, ten rows an item, as metrics read them twice
    hits = stored(_batch(spark, sf).select("query_id", F.col("element_id").alias("document_id"), "rank"), "hits")
    good = read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 40).alias("m")).distinct()
    met = hits.join(good, "document_id", "left").select("query_id", "document_id", "rank", F.coalesce(F.col("m") == F.col("query_id") % 40, F.lit(False)).alias("relevant"))
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m")).distinct()
    return met, items.join(good.groupBy("m").agg(F.count(F.lit(1)).alias("relevant")), "m").select("query_id", "relevant")


METRICS = f"""WITH {BM25 % MANY}, {TOP}, {GOLD}, h AS (SELECT query_id, element_id AS document_id, rank FROM r WHERE rank <= 10),
f AS (SELECT query_id, min(rank) AS first_rank, count(*) AS found FROM h JOIN gold USING (query_id, document_id) GROUP BY 1), t AS (SELECT query_id, count(DISTINCT document_id) AS relevant FROM gold GROUP BY 1),
qs AS (SELECT DISTINCT query_id FROM (SELECT query_id FROM h UNION ALL SELECT query_id FROM gold)),
m AS (SELECT query_id, first_rank, first_rank IS NOT NULL AS hit, round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank, round(coalesce(found, 0) / relevant, 6) AS recall FROM qs LEFT JOIN f USING (query_id) LEFT JOIN t USING (query_id))"""


@query(f"{METRICS} SELECT query_id, coalesce(first_rank, 0) AS first_rank, hit, reciprocal_rank, recall FROM m")
def hit_at_k(spark, sf):
    return evaluate.rank_metrics(*_judged(spark, sf), 10).fillna(0, ["first_rank"])


@query(f"{METRICS} SELECT round(avg(hit::INT), 6) AS hit_at_10, round(avg(reciprocal_rank), 6) AS mrr, round(avg(recall), 6) AS macro_recall FROM m")
def mrr(spark, sf):
    m = evaluate.rank_metrics(*_judged(spark, sf), 10)
    return m.agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_at_10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("macro_recall"))


@query(f"""WITH {LINES}, sp AS (SELECT doc_id AS document_id, quality AS span_id, doc_id % 30 AS a, doc_id % 30 + 5 AS b FROM labels)
SELECT el.document_id, pos, span_id FROM el JOIN sp ON el.document_id = sp.document_id AND start <= b AND stop >= a""")
def locator_overlap_join(spark, sf):
    cut = structure.line_elements(read(spark, sf, "documents").withColumnRenamed("doc_id", "document_id"))
    spans = read(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("span_id"), (F.col("doc_id") % 30).alias("span_start"), (F.col("doc_id") % 30 + 5).alias("span_stop"))
    return evaluate.overlapping(cut, spans).select("document_id", "pos", "span_id")


@query("SELECT event_type, quantile_disc(value, 0.95) AS nearest_rank, count(value) AS n FROM events GROUP BY event_type")
def nearest_rank_p95(spark, sf):
    return evaluate.nearest_rank(read(spark, sf, "events"), "event_type", "value", 0.95)


@query("SELECT lang, count_if(toxic = 1) AS toxic, count_if(quality = 1) AS good, round(count_if(toxic = 1 AND quality = 0) / nullif(count_if(toxic = 1), 0), 6) AS bad_share FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def ratio_null(spark, sf):
    joined = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("both")).select("lang", "toxic", "good", F.round(evaluate.ratio(F.col("both"), F.col("toxic")), 6).alias("bad_share"))


@query("SELECT count_if(quality = 1 AND toxic = 0) AS answered_right, count_if(quality = 1 AND toxic = 1) AS answered_wrong, count_if(quality = 0 AND toxic = 1) AS abstained_right, count_if(quality = 0 AND toxic = 0) AS abstained_wrong FROM labels")
def abstention_flags(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    return read(spark, sf, "labels").agg(F.count_if((q == 1) & (t == 0)).alias("answered_right"), F.count_if((q == 1) & (t == 1)).alias("answered_wrong"), F.count_if((q == 0) & (t == 1)).alias("abstained_right"), F.count_if((q == 0) & (t == 0)).alias("abstained_wrong"))


@query("""SELECT coalesce(a.k, b.k) AS answer_id, coalesce(len(list_filter(a.s, lambda x: NOT list_contains(coalesce(b.s, []), x))), 0) AS uncovered, coalesce(len(list_filter(b.s, lambda x: NOT list_contains(coalesce(a.s, []), x))), 0) AS dangling,
  a.s IS NOT NULL AND len(list_filter(a.s, lambda x: NOT list_contains(coalesce(b.s, []), x))) = 0 AS answered
FROM (SELECT o_custkey AS k, list(DISTINCT o_orderkey % 50) AS s FROM orders GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, list(DISTINCT l_orderkey % 50) AS s FROM lineitem GROUP BY 1) b ON a.k = b.k""")
def answer_coverage(spark, sf):
    need = read(spark, sf, "orders").select(F.col("o_custkey").alias("answer_id"), (F.col("o_orderkey") % 50).alias("requirement_id"))
    have = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("answer_id"), (F.col("l_orderkey") % 50).alias("requirement_id"))
    return evaluate.coverage(need, have)


@query("SELECT id, count(*) AS n FROM (SELECT md5(text) AS id FROM documents UNION ALL SELECT md5(text) FROM benchmark UNION ALL SELECT md5(text) FROM conversations) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return structure.repeated_ids(*[read(spark, sf, t).select(F.md5("text").alias("id")) for t in ("documents", "benchmark", "conversations")])


@query("SELECT label AS space, count(DISTINCT len(embedding)) AS dimensions, min(len(embedding)) AS dimension, count_if(NOT list_aggregate(list_transform(embedding, lambda x: x <> 0), 'bool_or')) AS zero_vectors FROM embeddings GROUP BY label")
def dimension_consistency(spark, sf):
    own = read(spark, sf, "embeddings").select(F.col("label").alias("space"), F.size("embedding").alias("d"), V.valid(V.doubles(F.col("embedding"))).alias("ok"))
    return own.groupBy("space").agg(F.countDistinct("d").alias("dimensions"), F.min("d").alias("dimension"), F.count_if(~F.col("ok")).alias("zero_vectors"))


@query("SELECT doc_id, 'text_' || sha256(source || doc_id::VARCHAR) AS text_id, 'doc_' || sha256('/corpus/' || doc_id::VARCHAR) AS document_id, sha256(coalesce(text, '')) AS text_hash FROM documents")
def evidence_ids(spark, sf):
    key = F.col("doc_id").cast("string")
    return read(spark, sf, "documents").select("doc_id", T.hashed_id("text_", F.col("source"), key).alias("text_id"), T.hashed_id("doc_", F.lit("/corpus/"), key).alias("document_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages")
def escape_html(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped_md5"))


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(list_extract(string_split(url, '/'), -1), '[\p{Cc}\p{Cf}]+', ' ', 'g'), '\s+', ' ', 'g')), ''), 'Untitled') AS title FROM pages")
def clean_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.clean_title(F.col("url")).alias("title"))


@query("""WITH i AS (SELECT DISTINCT sha256(text) AS id FROM documents), n AS (SELECT id, lag(id) OVER (ORDER BY id) AS p, lead(id) OVER (ORDER BY id) AS q FROM i),
l AS (SELECT id, (SELECT coalesce(min(k) - 1, 64) FROM range(1, 65) t(k) WHERE p IS NOT NULL AND substr(id, k::INT, 1) <> substr(p, k::INT, 1)) AS a, (SELECT coalesce(min(k) - 1, 64) FROM range(1, 65) t(k) WHERE q IS NOT NULL AND substr(id, k::INT, 1) <> substr(q, k::INT, 1)) AS b, p, q FROM n)
SELECT id, 'B-' || substr(id, 1, greatest(3, CASE WHEN p IS NULL THEN 1 ELSE a + 1 END, CASE WHEN q IS NULL THEN 1 ELSE b + 1 END)::INT) AS ref FROM l""")
def short_ref_unique(spark, sf):
    return structure.unique_prefixes(read(spark, sf, "documents").select(F.sha2("text", 256).alias("id")).distinct(), least=3)


@query("""SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce(a.title, b.title) AS title, greatest(a.pages, b.pages) AS pages, coalesce(a.active, FALSE) OR coalesce(b.active, FALSE) AS active
FROM (SELECT c_custkey AS book_id, c_name AS title, c_nationkey AS pages, c_acctbal > 5000 AS active FROM customer) a FULL JOIN (SELECT s_suppkey * 3 AS book_id, s_name AS title, s_nationkey AS pages, s_acctbal > 5000 AS active FROM supplier) b ON a.book_id = b.book_id""")
def books_merge_full_outer(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("pages"), (F.col("c_acctbal") > 5000).alias("active"))
    b = read(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("book_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("pages"), (F.col("s_acctbal") > 5000).alias("active"))
    return structure.merged_books(a, b)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_anti(spark, sf):
    used = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("SELECT count(*) AS revisions, count(DISTINCT source) AS documents, count_if(text IS NULL OR text = '') AS empty, count_if(strlen(text) > 10000) AS oversized, sum(strlen(text)) AS bytes FROM documents")
def integrity_counts(spark, sf):
    size = F.octet_length("text")
    return read(spark, sf, "documents").agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("source").alias("documents"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_if(size > 10000).alias("oversized"), F.sum(size).alias("bytes"))


@query("""SELECT code, count(*) AS n FROM (SELECT 'long_text' AS code FROM documents WHERE length(text) > 5000 UNION ALL SELECT 'wrong_length' FROM documents WHERE n_chars <> length(text) UNION ALL
SELECT 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unknown_document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) GROUP BY code""")
def capture_violations(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rule = lambda df, code: df.select(F.lit(code).alias("code"))
    found = (
        rule(docs.where(F.length("text") > 5000), "long_text").unionByName(rule(docs.where(F.col("n_chars") != F.length("text")), "wrong_length"))
        .unionByName(rule(docs.join(labels, "doc_id", "left_anti"), "unlabelled")).unionByName(rule(labels.join(docs, "doc_id", "left_anti"), "unknown_document"))
    )
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS document_id, count(*) AS n_elements, count_if(lang = 'en') AS n_images, sum(n_chars) AS n_chars FROM documents GROUP BY source")
def list_documents(spark, sf):
    return read(spark, sf, "documents").groupBy(F.col("source").alias("document_id")).agg(F.count(F.lit(1)).alias("n_elements"), F.count_if(F.col("lang") == "en").alias("n_images"), F.sum("n_chars").alias("n_chars"))


def _stop(start: str) -> str:
    """Where the chunk ends that begins at ``start`` of the text t of length n."""

    def nearest(pattern: str) -> str:
        near = f"substr(t, {start} + 601, 600)"
        found, gaps = f"regexp_extract_all({near}, '{pattern}')", f"string_split_regex({near}, '{pattern}')"
        ends = f"list_transform(range(1, len({found}) + 1), lambda i: list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + list_sum(list_transform({found}[1:i], lambda x: length(x))))"
        return f"({start} + 600 + list_sort(list_transform({ends}, lambda e: abs(e - 200) * 10000 + e))[1] % 10000)"

    patterns = [r"\n\s*\n", r"\n", r"[。！？]|[.!?](?:\s+|$)"]
    return f"CASE WHEN n - ({start}) <= 1200 THEN n ELSE coalesce({', '.join(map(nearest, patterns))}, {start} + 800) END::INT"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text)::INT AS n FROM documents WHERE text <> ''),
c AS (SELECT doc_id, 0 AS pos, 0 AS start, {_stop('0')} AS stop FROM d UNION ALL SELECT doc_id, pos + 1, stop - 100, {_stop('stop - 100')} FROM c JOIN d USING (doc_id) WHERE stop < n)
SELECT doc_id AS document_id, pos, start, stop, sha256(substr(t, start + 1, stop - start)) AS text_hash FROM c JOIN d USING (doc_id)""")
def retrieval_chunks(spark, sf):
    cut = chunking.retrieval_chunks(read(spark, sf, "documents").withColumnRenamed("doc_id", "document_id"))
    return cut.select("document_id", "pos", "start", "stop", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {LINES} SELECT document_id::VARCHAR AS document_id, pos, start, stop, sha256(text) AS text_hash FROM el WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def catalogue_snapshot(spark, sf):
    store = CatalogueStore(spark, _scratch(spark, "catalogue"), ingestion.SCHEMA)
    epoch = store.publish(ingestion.elements(read(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")), 0)
    store.remove(read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id")), epoch)
    return store.snapshot().select("document_id", "pos", "start", "stop", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {LINES} SELECT document_id::VARCHAR AS document_id, pos, start, stop, sha256(text) AS text_hash FROM el")
def stream_ingest(spark, sf):
    folder = _scratch(spark, "ingest")
    store = CatalogueStore(spark, f"{folder}/catalogue", ingestion.SCHEMA)
    # a pattern, since a stream does not take the path of a single file
    rows = spark.readStream.schema(read(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    ingestion.ingest(rows.select(F.col("doc_id").alias("document_id"), "text"), store, f"{folder}/checkpoint")
    return store.snapshot().select("document_id", "pos", "start", "stop", F.sha2("text", 256).alias("text_hash"))
