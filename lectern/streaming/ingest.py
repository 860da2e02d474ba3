"""Incremental ingestion with Structured Streaming: new files become elements of the catalogue, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.chunking import retrieval_chunks
from lectern.operators.structure import line_elements
from lectern.sources.catalogue_store import CatalogueStore
from lectern.sources.window_store import WindowStore

SCHEMA = "document_id string, revision string, pos int, start int, stop int, text string"


def elements(documents: DataFrame) -> DataFrame:
    """The catalogue's rows from (document_id, text): elements of 20 lines under the text's digest as revision."""
    own = documents.select(F.col("document_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = own.select(F.struct("document_id", F.sha2("text", 256).alias("revision")).alias("document_id"), "text")
    return line_elements(keyed).select("document_id.document_id", "document_id.revision", "pos", "start", "stop", "text")


def ingest(documents: DataFrame, store: CatalogueStore, checkpoint: str) -> None:
    """Publish all that a streaming (document_id, text) table has at hand, one commit for each micro-batch.

    A micro-batch that Spark repeats after a failure carries the same number, and the store commits a number once.
    """

    def commit(rows: DataFrame, number: int) -> None:
        store.publish(elements(rows), store.epoch(), batch=f"{checkpoint}#{number}")

    documents.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: How long the bytes of a source are remembered, so that the same ones start no second job.
REMEMBERED = "30 days"


def started(sources: DataFrame, arrived: str = "arrived") -> DataFrame:
    """A streaming (job_id, source_hash, bytes) table with one row for equal bytes, across micro-batches and restarts.

    sources: (content, arrived): the state is one hash a job, dropped when the watermark passes it. Null content counts as
    empty; of equal sources it is not said which one starts the job; a null time counts as known bytes' first arrival.
    """
    content = F.coalesce("content", F.lit(""))
    own = sources.select(F.sha2(content, 256).alias("source_hash"), F.octet_length(content).cast("long").alias("bytes"), F.col(arrived).alias("arrived"))
    once = own.withWatermark("arrived", REMEMBERED).dropDuplicatesWithinWatermark(["source_hash"])
    return once.select(F.concat(F.lit("book_"), "source_hash").alias("job_id"), "source_hash", "bytes")


def start_jobs(sources: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Start jobs for all sources at hand; the jobs of all runs so far."""
    writer = started(sources).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return sources.sparkSession.read.schema("job_id string, source_hash string, bytes long").parquet(out)


#: Pages of a window.
PAGES = 5


def windows(pages: DataFrame) -> DataFrame:
    """(book_id, window_no, elements) from (book_id, page, text): five pages a window, their retrieval chunks as elements."""
    own = pages.select(F.concat_ws("\u0001", F.col("page").cast("string"), F.col("book_id").cast("string")).alias("document_id"), "text")
    cut = retrieval_chunks(own).select(F.split("document_id", "\u0001", 2).alias("key"), "pos", "text")
    each = cut.select(F.col("key")[1].alias("book_id"), F.col("key")[0].cast("long").alias("page"), "pos", "text")
    place = F.floor((F.col("page") - 1) / PAGES).alias("window_no")
    # pages of a window are few, and a record is bounded, so a window is a small group
    grouped = each.groupBy("book_id", place).agg(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))).alias("e"))
    return grouped.select("book_id", "window_no", F.transform("e", lambda e, i: F.struct(i.alias("pos"), e["page"].alias("page"), e["text"].alias("text"))).alias("elements"))


def parse(pages: DataFrame, store: WindowStore, checkpoint: str, name: str = "parse") -> None:
    """The parse phase: windows of a streaming (book_id, page, text) table, a checkpoint for each micro-batch.

    A window's pages come in one file; a window that comes again in another is refused. Pages count from 1; pages without text have no elements.
    """
    commit = lambda rows, number: store.save(windows(rows), f"{name}-{number}")
    pages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
