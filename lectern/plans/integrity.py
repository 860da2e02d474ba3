"""Queries of the integrity rules, of evidence and of answers.

A source is a document; its elements are the rows under it, named by the first signs of their text, so that names repeat
and break their rule; an element's locator is a page, lines or an anchor by the rest of doc_id by three. Images come from
``pages``, a page linked to the elements of its number and the next. Limits are low, so that budgets break too.
A conversation is a bundle and an answer: its turns are texts, and each turn is a block on the turn after it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import identity
from lectern.functions import text as T
from lectern.operators import answers, rules

from .catalogue import query, read

LIMITS = rules.Limits(elements=30, images=20, label=3, text=3000, total=100_000)


def capture(spark, sf):
    docs = read(spark, sf, "documents").where("source is not null")
    n = F.col("doc_id")
    place = [F.element_at(F.array(F.lit("page"), F.lit("lines"), F.lit("anchor")), (n % 3 + 1).cast("int")).alias("kind"), (n % 7).cast("int").alias("page"), (n % 5).cast("int").alias("start"), (n % 4).cast("int").alias("stop"), F.col("lang").alias("anchor")]
    key = F.concat(F.lit("doc_"), F.sha2("source", 256))
    elements = docs.select(key.alias("document_id"), F.substring(F.coalesce("text", F.lit("")), 1, 14).alias("element_id"), F.coalesce("text", F.lit("")).alias("text"), *place)
    heads = docs.select(key.alias("document_id"), F.sha2("source", 256).alias("source_hash"), F.col("source").alias("label"), F.lit("rows-v1").alias("parser")).distinct()
    pages = read(spark, sf, "pages").withColumn("doc_id", F.col("page_id")).join(docs.select("doc_id", "source", "lang", F.col("text").alias("own")), "doc_id")
    images = pages.select(
        key.alias("document_id"), F.concat(F.lit("image_"), n.cast("string")).alias("image_id"), F.when(n % 9 == 0, F.md5("html")).otherwise(F.sha2("html", 256)).alias("blob_hash"), F.col("url").alias("caption"),
        F.when(n % 11 == 0, "drawn").otherwise("page_render").alias("origin"), F.array(F.substring(F.coalesce("own", F.lit("")), 1, 14), F.lit("image_0")).alias("element_ids"), *place,
    )
    return heads, elements, images


CAPTURE = r"""
d AS (SELECT *, 'doc_' || sha256(source) AS document_id, substr(coalesce(text, ''), 1, 14) AS element_id, coalesce(text, '') AS body,
  ['page', 'lines', 'anchor'][doc_id % 3 + 1] AS kind, doc_id % 7 AS page, doc_id % 5 AS start, doc_id % 4 AS stop FROM documents WHERE source IS NOT NULL),
placed AS (SELECT *, coalesce((kind = 'page' AND page > 0) OR (kind = 'lines' AND start > 0 AND stop >= start) OR (kind = 'anchor' AND lang IS NOT NULL), FALSE) AS ok FROM d),
img AS (SELECT document_id, 'image_' || doc_id AS image_id, CASE WHEN doc_id % 9 = 0 THEN md5(html) ELSE sha256(html) END AS blob_hash, CASE WHEN doc_id % 11 = 0 THEN 'drawn' ELSE 'page_render' END AS origin, [element_id, 'image_0'] AS element_ids, ok
  FROM placed JOIN pages ON page_id = doc_id),
items AS (SELECT document_id, element_id AS id, ok FROM placed UNION ALL SELECT document_id, image_id, ok FROM img),
v AS (SELECT 'label' AS code FROM (SELECT DISTINCT source FROM d) WHERE length(source) > 3
 UNION ALL SELECT 'identifier' FROM items WHERE NOT regexp_full_match(id, '[A-Za-z0-9_-]{1,128}') UNION ALL SELECT 'locator' FROM items WHERE NOT ok
 UNION ALL SELECT 'duplicate' FROM (SELECT 1 FROM items GROUP BY document_id, id HAVING count(*) > 1)
 UNION ALL SELECT 'elements' FROM (SELECT 1 FROM d GROUP BY document_id HAVING count(*) > 30) UNION ALL SELECT 'text_budget' FROM (SELECT 1 FROM d GROUP BY document_id HAVING sum(length(body)) > 100000)
 UNION ALL SELECT 'images' FROM (SELECT 1 FROM img GROUP BY document_id HAVING count(*) > 20) UNION ALL SELECT 'text' FROM d WHERE length(body) > 3000
 UNION ALL SELECT 'image' FROM img WHERE length(blob_hash) <> 64 OR origin = 'drawn'
 UNION ALL SELECT 'unknown_element' FROM (SELECT document_id, image_id, unnest(element_ids) AS element_id FROM img) x WHERE NOT EXISTS (FROM d WHERE d.document_id = x.document_id AND d.element_id = x.element_id))"""


@query(f"WITH {CAPTURE} SELECT code, count(*) AS n FROM v GROUP BY code")
def capture_rule_violations(spark, sf):
    return rules.counted(rules.capture_rules(*capture(spark, sf), LIMITS))


@query("""WITH p AS (SELECT conv_id AS document_id, turn + 1 AS page, length(text) AS n, text FROM conversations),
e AS (SELECT document_id, page, 0 AS start, n AS stop, n AS own FROM p WHERE page % 5 <> 0 UNION ALL SELECT document_id, page, n + (page % 3)::INT, n + (page % 3)::INT + 2, 2 FROM p WHERE page % 5 <> 0),
i AS (SELECT document_id, page FROM p WHERE page % 7 <> 0),
v AS (SELECT 'page_sequence' AS code FROM (SELECT document_id FROM i GROUP BY 1 HAVING NOT (count(*) = count(DISTINCT page) AND min(page) = 1 AND max(page) = count(*)))
 UNION ALL SELECT 'page_without_text' FROM i WHERE page % 5 = 0 UNION ALL SELECT 'text_without_page' FROM e WHERE page % 7 = 0
 UNION ALL SELECT 'transcript' FROM (SELECT 1 FROM e GROUP BY document_id, page HAVING NOT (min(start) = 0 AND sum(stop - start) = max(stop) AND count(DISTINCT start) = count(*) AND count_if(stop - start <> own) = 0)))
SELECT code, count(*) AS n FROM v GROUP BY code""")
def ocr_rule_violations(spark, sf):
    """A turn is a page of its conversation; its transcript is the text and two more signs, which start too late on two pages of three."""
    p = read(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page"), "text").withColumn("n", F.length("text"))
    said = p.where("page % 5 <> 0")
    late = (F.col("n") + F.col("page") % 3).cast("int")
    elements = said.select("document_id", "page", F.lit(0).alias("start"), F.col("n").alias("stop"), "text").unionByName(said.select("document_id", "page", late.alias("start"), (late + 2).alias("stop"), F.lit("ok").alias("text")))
    return rules.counted(rules.ocr_rules(elements, p.where("page % 7 <> 0").select("document_id", "page")))


def bundles(spark, sf):
    turns = read(spark, sf, "conversations")
    own = lambda t: F.concat(F.lit("text_"), F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string")), 256))
    size = F.length("text")
    late, long = (F.col("turn") % 4 == 3), (F.col("turn") % 3 == 2)
    texts = turns.select(
        F.col("conv_id").alias("bundle_id"), own(F.col("turn")).alias("id"), own(F.col("turn")).alias("element_id"), "text", F.col("role").alias("source_id"),
        F.when(late, F.md5("text")).otherwise(F.sha2("text", 256)).alias("text_hash"), F.lit(0).alias("start"), (size + long.cast("int")).alias("stop"),
    )
    blocks = turns.select(
        F.col("conv_id").alias("bundle_id"), F.col("turn").alias("block"), F.when(F.col("role") == "user", "paragraph").otherwise("figure").alias("kind"), own(F.col("turn")).alias("occurrence_id"),
        F.when(F.col("turn") == 0, F.array().cast("array<string>")).otherwise(F.array(own(F.col("turn") + 1))).alias("evidence_ids"),
    )
    figures = turns.where("role <> 'user' and turn % 2 = 1").select(F.col("conv_id").alias("bundle_id"), own(F.col("turn")).alias("id"), F.col("role").alias("source_id"))
    return texts, blocks, figures


BUNDLES = """c AS (SELECT *, conv_id || ':' || turn AS k, conv_id || ':' || (turn + 1) AS nxt, role <> 'user' AND turn % 2 = 1 AS fig FROM conversations)"""


@query(f"""WITH {BUNDLES}, v AS (SELECT 'text_hash' AS code FROM c WHERE turn % 4 = 3 UNION ALL SELECT 'offsets' FROM c WHERE turn % 3 = 2
 UNION ALL SELECT 'duplicate' FROM (SELECT k FROM (SELECT k FROM c UNION ALL SELECT k FROM c WHERE fig) GROUP BY k HAVING count(*) > 1)
 UNION ALL SELECT 'texts' FROM (SELECT 1 FROM c GROUP BY conv_id HAVING count(*) > 3) UNION ALL SELECT 'block_without_evidence' FROM c WHERE turn = 0
 UNION ALL SELECT 'unknown_evidence' FROM c WHERE turn > 0 AND nxt NOT IN (SELECT k FROM c)
 UNION ALL SELECT 'unknown_figure' FROM c WHERE role IS DISTINCT FROM 'user' AND NOT fig)
SELECT code, count(*) AS n FROM v GROUP BY code""")
def evidence_rule_violations(spark, sf):
    texts, blocks, figures = bundles(spark, sf)
    return rules.counted(rules.evidence_rules(texts, texts.select("element_id", "text"), blocks, figures, most=3))


@query(f"""WITH {BUNDLES}, t AS (SELECT conv_id, 'text' AS kind, k, role FROM c WHERE k IN (SELECT nxt FROM c WHERE turn > 0) UNION ALL SELECT conv_id, 'figure', k, role FROM c WHERE fig)
SELECT conv_id AS bundle_id, kind, 'text_' || sha256(k) AS id FROM t UNION ALL SELECT DISTINCT conv_id, 'source', role FROM t WHERE role IN (SELECT role FROM conversations)""")
def export_closure(spark, sf):
    texts, blocks, figures = bundles(spark, sf)
    sources = read(spark, sf, "conversations").select(F.col("role").alias("id")).distinct()
    return rules.export_closure(blocks, texts.select("bundle_id", "id", "source_id"), figures, sources)


@query("""WITH r AS (SELECT DISTINCT source AS d, lang AS v FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), a AS (SELECT d, max(v) AS v FROM r GROUP BY d),
h AS (SELECT source AS d, lang AS v FROM documents JOIN benchmark ON doc_id = item_id WHERE source IS NOT NULL), e AS (SELECT source AS d, lang AS v FROM documents JOIN embeddings ON doc_id = vec_id WHERE source IS NOT NULL),
b AS (SELECT DISTINCT sha256(url) AS hash FROM pages), u AS (SELECT sha256(d) AS hash FROM r UNION SELECT sha256(url) FROM pages WHERE page_id % 3 > 0)
SELECT (SELECT count(*) FROM r) AS revisions, (SELECT count(*) FROM a) AS active, (SELECT count(*) FROM r WHERE (d, v) NOT IN (SELECT (d, v) FROM a)) AS inactive, 0 AS dangling, (SELECT count(*) FROM h) AS hints,
 (SELECT count(*) FROM h WHERE NOT EXISTS (FROM r WHERE r.d = h.d AND r.v = h.v)) AS unbound_hints, (SELECT count(*) FROM e) AS vectors, (SELECT count(*) FROM b) AS blobs, (SELECT count(*) FROM b WHERE hash NOT IN (SELECT hash FROM u)) AS orphans, 0 AS corrupt,
 CASE WHEN (SELECT count(*) FROM h WHERE NOT EXISTS (FROM r WHERE r.d = h.d AND r.v = h.v)) > 0 THEN 'failed' WHEN (SELECT count(*) FROM e) > 0 THEN 'incomplete' ELSE 'passed' END AS verdict""")
def collection_audit(spark, sf):
    docs = read(spark, sf, "documents").where("source is not null").select("doc_id", F.col("source").alias("document_id"), F.col("lang").alias("revision"))
    revisions = docs.where("revision is not null").select("document_id", "revision").distinct().withColumn("source_hash", F.sha2("document_id", 256))
    active = revisions.groupBy("document_id").agg(F.max("revision").alias("revision"))
    of = lambda name, key: docs.join(read(spark, sf, name).select(F.col(key).alias("doc_id")), "doc_id").select("document_id", "revision")
    pages = read(spark, sf, "pages").select("page_id", F.sha2("url", 256).alias("blob_hash"))
    blobs = pages.select(F.col("blob_hash").alias("hash")).distinct().withColumn("ok", F.col("hash").rlike(rules.HASH))
    return rules.audit(revisions, active, of("benchmark", "item_id"), of("embeddings", "vec_id"), blobs, pages.where("page_id % 3 > 0").select("blob_hash"))


def answered(spark, sf):
    turns = read(spark, sf, "conversations")
    key = lambda t: t.cast("string")
    status = F.element_at(F.array(*map(F.lit, ["supported", "supported", "missing", "conflicting", "unassessed", "odd"])), (F.length("text") % 6 + 1).cast("int"))
    user, turn = F.col("role") == "user", F.col("turn")
    requirements = turns.where(user).select(F.col("conv_id").alias("answer_id"), key(turn).alias("requirement_id"), status.alias("status"), F.when(status == "missing", F.array().cast("array<string>")).otherwise(F.array(key(turn + 1))).alias("evidence_ids"))
    texts = turns.where(~user & (turn % 5 < 4)).select(F.col("conv_id").alias("answer_id"), key(turn).alias("text_id"))
    paragraphs = turns.where(~user).select(F.col("conv_id").alias("answer_id"), turn.alias("ord"), F.array(key(turn)).alias("evidence_ids"), F.array(key(turn - 1)).alias("requirement_ids"))
    return requirements, texts, paragraphs


ANSWERS = """q AS (SELECT conv_id AS answer_id, turn::VARCHAR AS requirement_id, ['supported', 'supported', 'missing', 'conflicting', 'unassessed', 'odd'][length(text) % 6 + 1] AS status, turn FROM conversations WHERE role = 'user'),
r AS (SELECT *, CASE WHEN status = 'missing' THEN NULL ELSE (turn + 1)::VARCHAR END AS ev FROM q),
t AS (SELECT conv_id AS answer_id, turn::VARCHAR AS id FROM conversations WHERE role <> 'user' AND turn % 5 < 4),
p AS (SELECT conv_id AS answer_id, turn AS ord, turn::VARCHAR AS ev, (turn - 1)::VARCHAR AS rq FROM conversations WHERE role <> 'user'),
m AS (SELECT p.answer_id, ord, p.ev, r.requirement_id IS NOT NULL AS known, r.ev AS has FROM p LEFT JOIN r ON r.answer_id = p.answer_id AND r.requirement_id = p.rq)"""


@query(f"""WITH {ANSWERS}, v AS (SELECT 'status' AS code FROM r WHERE status = 'odd' UNION ALL SELECT 'duplicate_requirement' FROM (SELECT 1 FROM r GROUP BY answer_id, requirement_id HAVING count(*) > 1)
 UNION ALL SELECT 'conflict_of_one' FROM r WHERE status = 'conflicting'
 UNION ALL SELECT 'unknown_evidence' FROM (SELECT answer_id, ev FROM r WHERE ev IS NOT NULL UNION ALL SELECT answer_id, ev FROM p) x WHERE (answer_id, ev) NOT IN (SELECT (answer_id, id) FROM t)
 UNION ALL SELECT 'unknown_requirement' FROM m WHERE NOT known UNION ALL SELECT 'false_mapping' FROM m WHERE known AND has IS DISTINCT FROM ev
 UNION ALL SELECT 'false_mapping' FROM (SELECT answer_id, ord FROM m GROUP BY answer_id, ord HAVING NOT bool_or(coalesce(has = ev, FALSE))))
SELECT code, count(*) AS n FROM v GROUP BY code""")
def answer_violations(spark, sf):
    return answers.violations(*answered(spark, sf)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ANSWERS}, u AS (SELECT answer_id, rq, list(DISTINCT ev) AS used FROM p GROUP BY ALL),
n AS (SELECT r.answer_id, count_if(used IS NULL)::BIGINT AS uncovered, sum(CASE WHEN r.ev IS NOT NULL AND NOT list_contains(coalesce(used, []), r.ev) THEN 1 ELSE 0 END)::BIGINT AS missing_mappings, max(CASE WHEN status = 'missing' THEN 'missing-support' END) AS a, max(CASE WHEN status = 'conflicting' THEN 'conflicting-evidence' END) AS b, max(CASE WHEN status = 'unassessed' THEN 'unassessed' END) AS c
  FROM r LEFT JOIN u ON u.answer_id = r.answer_id AND u.rq = r.requirement_id GROUP BY 1),
f AS (SELECT n.answer_id, (n.answer_id NOT IN (SELECT answer_id FROM p))::INT AS empty_blocks, uncovered, missing_mappings, concat_ws(',', CASE WHEN n.answer_id NOT IN (SELECT answer_id FROM t) THEN 'no-candidates' END, a, b, c) AS reasons FROM n)
SELECT *, CASE WHEN reasons = '' AND empty_blocks = 0 AND uncovered = 0 AND missing_mappings = 0 THEN 'answered' ELSE 'insufficient-evidence' END AS status FROM f""")
def validate_answers(spark, sf):
    return answers.diagnostics(*answered(spark, sf))


@query("SELECT event_id, json_keys(props) = ['k'] AS exact, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strlen(props) <= 8 AS within FROM events")
def parsed_records(spark, sf):
    """JSON records of bounded size with exactly the keys that they should have."""
    props = F.col("props")
    k = F.from_json(props, "k bigint", {"mode": "PERMISSIVE"})["k"]
    return read(spark, sf, "events").select("event_id", T.exact_keys(props, ["k"]).alias("exact"), k.alias("k"), (F.octet_length(props) <= 8).alias("within"))


@query(r"""SELECT doc_id, sha256('["' || coalesce(lang, 'x') || '","model","3","cosine","text-v1"]') AS space_key, sha256('["embedding-v1","' || doc_id || '","7",null]') AS embedding_identity,
  'hint_' || sha256('["vision-hint-v1","' || doc_id || '","' || n_chars || '"]') AS hint_id, 'figure_' || sha256('src' || doc_id) AS figure_id,
  sha256('["batch-v1","' || doc_id || '","0","4","' || sha256(coalesce(text, '') || chr(0) || 'end') || '"]') AS binding, sha256('["vision-model-v1","' || doc_id || '"]') AS model_fingerprint,
  sha256('["vision-prompt-v1","' || n_chars || '"]') AS prompt_fingerprint, sha256('["reranker-v1","local","' || doc_id || '"]') AS reranker,
  sha256('h' || chr(10) || 'p' || chr(10) || '[' || doc_id || ',' || n_chars || ']' || chr(10) || '[]') AS revision FROM documents""")
def identities(spark, sf):
    key = F.col("doc_id").cast("string")
    model, prompt = identity.vision_fingerprints(key, F.col("n_chars"))
    return read(spark, sf, "documents").select(
        "doc_id", identity.space_key(F.coalesce("lang", F.lit("x")), F.lit("model"), F.lit(3)).alias("space_key"), identity.embedding_identity(key, F.lit(7), F.lit(None)).alias("embedding_identity"),
        identity.hint_id(key, F.col("n_chars")).alias("hint_id"), identity.figure_id(F.lit("src"), key).alias("figure_id"), identity.batch_binding(key, F.lit(0), F.lit(4), F.array(F.coalesce("text", F.lit("")), F.lit("end"))).alias("binding"),
        model.alias("model_fingerprint"), prompt.alias("prompt_fingerprint"), identity.reranker_fingerprint(F.lit("local"), key).alias("reranker"),
        identity.capture_revision(F.lit("h"), F.lit("p"), F.array("doc_id", "n_chars"), F.array().cast("array<string>")).alias("revision"),
    )
