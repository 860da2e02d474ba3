"""Queries that run streams over files they lay out, and read what the streams have written.

``documents`` are published in three epochs (by doc_id), or come as source files in three batches; ``events`` are the log
of jobs (a user is a job).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import chunking, jobs
from lectern.operators.embedding import Lengths, Space, embedded
from lectern.sources.catalogue_store import CatalogueStore
from lectern.sources.scratch import scratch as _scratch
from lectern.sources.scratch import stored
from lectern.sources.window_store import WindowStore
from lectern.streaming import indexing, ingest, job_state

from .catalogue import ORACLE_SQL, query, read
from .retrieval import EMBED

SPACE = Space("local", "lengths", "1", 17)


def total():
    return F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total")


#: The chunks of ``retrieval_chunks`` with their texts.
CHUNKS = ORACLE_SQL["retrieval_chunks"].rsplit("SELECT", 1)[0].rstrip() + ", el AS (SELECT doc_id AS document_id, pos, substr(t, start + 1, stop - start) AS text FROM c JOIN d USING (doc_id))"


def chunks(spark, sf):
    """The catalogue's rows: documents cut into retrieval chunks, under the text's digest as revision."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    cut = chunking.retrieval_chunks(docs)
    own = cut.join(docs.select("document_id", F.sha2("text", 256).alias("revision")), "document_id")
    return own.select("document_id", "revision", "pos", "start", "stop", "text")


def _published(spark, sf, folder, after):
    """The index behind a catalogue of three publications; ``after``: those behind which its stream runs."""
    store = CatalogueStore(spark, f"{folder}/catalogue", ingest.SCHEMA)
    index, rows = indexing.VectorIndex(store, folder, SPACE, Lengths(SPACE)), stored(chunks(spark, sf), "chunks")
    for k in range(3):
        store.publish(rows.where(F.col("document_id").cast("long") % 3 == k), k)
        if k in after:
            index.run(f"{folder}/cursor")
    return index


@query(f"{CHUNKS} SELECT document_id::VARCHAR AS document_id, pos, len({EMBED}) AS dimension, round(list_sum({EMBED}), 6) AS total FROM el")
def stream_index(spark, sf):
    """The index phase as a stream behind the catalogue; it runs twice, the second time over two publications."""
    folder = _scratch(spark, "index")
    index = _published(spark, sf, folder, (0, 2))
    return index.vectors().select("document_id", "pos", F.size("vector").alias("dimension"), total())


@query(f"""{CHUNKS}, n AS (SELECT document_id, (max(pos) + 4) // 4 AS batches FROM el GROUP BY 1) SELECT document_id::VARCHAR AS document_id, batches,
CASE WHEN document_id % 3 = 2 THEN 0 ELSE batches END AS stored, CASE WHEN document_id % 3 = 2 THEN 'parsed' ELSE 'ready' END AS state FROM n""")
def index_progress(spark, sf):
    """How far each document is when the third publication came after the index phase."""
    index = _published(spark, sf, _scratch(spark, "progress"), (1,))
    return index.progress().select("document_id", "batches", "stored", "state")


@query(f"SELECT doc_id, len({EMBED}) AS dimension, round(list_sum({EMBED}), 6) AS total FROM documents WHERE length(coalesce(text, '')) <= 32768")
def embedded_batches(spark, sf):
    """Bounded, checked calls of a provider; texts beyond a call's units, which it would refuse, are left out before."""
    own = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= 32_768)
    return embedded(own, SPACE, Lengths(SPACE)).select("doc_id", F.size("vector").alias("dimension"), total())


STATE_SQL = """e AS (SELECT user_id AS j, event_id AS s, ['parsing', 'parsed', 'indexing', 'ready', 'noise'][event_id % 5 + 1] AS st FROM events),
a AS (SELECT j, min(s) AS t FROM e WHERE st = 'parsing' GROUP BY j), b AS (SELECT e.j, min(s) AS t FROM e JOIN a ON a.j = e.j AND s > a.t WHERE st = 'parsed' GROUP BY e.j),
c AS (SELECT e.j, min(s) AS t FROM e JOIN b ON b.j = e.j AND s > b.t WHERE st = 'indexing' GROUP BY e.j), d AS (SELECT e.j, min(s) AS t FROM e JOIN c ON c.j = e.j AND s > c.t WHERE st = 'ready' GROUP BY e.j)"""


def _log(spark, sf, folder, parts=3):
    """The events of ``sf`` as a streaming log of files, a batch each; ``at`` runs with the time."""
    events = read(spark, sf, "events")
    cuts = [r[0] for r in events.agg(F.percentile_approx("ts", [k / parts for k in range(1, parts)]).alias("c")).select(F.explode("c")).collect()]
    part = sum((F.col("ts") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    for k in range(parts):
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")


@query(f"""WITH {STATE_SQL} SELECT u.j::VARCHAR AS job_id, CASE WHEN d.t IS NOT NULL THEN 'ready' WHEN c.t IS NOT NULL THEN 'indexing' WHEN b.t IS NOT NULL THEN 'parsed' WHEN a.t IS NOT NULL THEN 'parsing' END AS state,
coalesce(d.t, c.t, b.t, a.t, -1) AS since FROM (SELECT DISTINCT j FROM e) u LEFT JOIN a USING (j) LEFT JOIN b USING (j) LEFT JOIN c USING (j) LEFT JOIN d USING (j)""")
def job_stream(spark, sf):
    """The states of jobs from a live log; what ``job_states`` says of the finished one. Numbers are the order, as there."""
    folder = _scratch(spark, "jobs")
    state = F.element_at(F.array(*map(F.lit, [*jobs.STATES, "noise"])), (F.col("event_id") % 5 + 1).cast("int"))
    events = read(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.lit(0).alias("at"), F.lit("state").alias("kind"), state.alias("value"))
    middle = events.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    for early in (True, False):
        events.where(F.col("seq") <= middle if early else F.col("seq") > middle).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        log = spark.readStream.schema(events.schema).parquet(f"{folder}/log")
        found = job_state.run(log, f"{folder}/changes", f"{folder}/state")
    return job_state.current(found)


@query("""WITH e AS (SELECT user_id AS job_id, event_id AS seq, ts, floor(value)::INT % 3 AS worker, event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) AS claim FROM events),
c AS (SELECT *, last_value(CASE WHEN claim THEN {'w': worker, 't': ts} END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM e)
SELECT job_id::VARCHAR AS job_id, seq, coalesce(h.w = worker AND epoch_us(ts) - epoch_us(h.t) <= 7200 * 1000000::BIGINT, FALSE) AS accepted FROM c WHERE NOT claim""")
def lease_stream(spark, sf):
    """Leases from a live log in three batches, by the events' times; what ``lease_fencing`` says of the finished one."""
    folder = _scratch(spark, "leases")
    kinds = [r[0] for r in read(spark, sf, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    kind = F.when(F.col("event_type").isin(kinds), "claim").otherwise("result")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = _log(spark, sf, folder).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), micros.alias("at"), kind.alias("kind"), (F.floor("value").cast("int") % 3).alias("value"))
    found = job_state.run(events, f"{folder}/changes", f"{folder}/state", lease=7200, exclusive=False, renew=False)
    return found.where("kind = 'result'").select("job_id", "seq", "accepted")


@query("SELECT DISTINCT 'book_' || sha256(coalesce(text, '')) AS job_id, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents")
def stream_jobs(spark, sf):
    """Sources in three files, a micro-batch each, after a run that has seen the first of them: equal bytes start one job."""
    folder = _scratch(spark, "sources")
    docs = read(spark, sf, "documents").select(F.col("text").alias("content"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("arrived"), (F.col("doc_id") % 3).alias("k"))
    found = None
    for k in range(3):
        docs.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k != 1:
            sources = spark.readStream.schema("content string, arrived timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            found = ingest.start_jobs(sources, f"{folder}/jobs", f"{folder}/state")
    return found.select("job_id", "bytes")


@query(f"""{CHUNKS}, k AS (SELECT source AS book_id, document_id + 1 AS page, text FROM el JOIN (SELECT doc_id, source FROM documents) ON doc_id = document_id WHERE source IS NOT NULL)
SELECT book_id, (page - 1) // 5 AS window_no, count(*) AS elements, sum(length(text))::BIGINT AS chars, min(page) AS first_page, max(page) AS last_page FROM k GROUP BY ALL""")
def book_windows(spark, sf):
    """The parse phase over two deliveries (sources as books, documents as pages), a checkpoint each; windows read back one by one, whatever a book's size."""
    folder = _scratch(spark, "windows")
    own = read(spark, sf, "documents").where("source is not null").select(F.col("source").alias("book_id"), (F.col("doc_id") + 1).alias("page"), "text")
    store = WindowStore(spark, folder)
    for k in range(2):
        own.where(F.pmod(F.hash("book_id"), F.lit(2)) == k).write.mode("append").option("compression", "zstd").parquet(f"{folder}/pages")
        ingest.parse(spark.readStream.schema(own.schema).parquet(f"{folder}/pages"), store, f"{folder}/cursor")
    each = store.windows().select("book_id", "window_no", F.explode("elements").alias("e")).select("book_id", "window_no", "e.page", F.length("e.text").alias("n"))
    per = each.groupBy("book_id", "window_no")
    return per.agg(F.count(F.lit(1)).alias("elements"), F.sum("n").alias("chars"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
