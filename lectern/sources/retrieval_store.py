"""Vectors and hints of a catalogue's documents.

* ``VectorStore``: vectors by space, document, revision and element, in a folder for each space and bucket of documents,
  rows in order of their keys. Saving replaces the buckets that it touches (dynamic partition overwrite) with their rows
  but those of the elements that are saved, so no old row is left and a read needs no aggregation. A document's vectors
  are found by its bucket's folder and the row groups that hold its id. A save costs the buckets it touches, so save many documents
  at once. A batch is refused as a whole if a vector has another dimension, is not finite or is all zeros, if an element
  comes twice, or if its document's revision is not active.
* ``HintStore``: descriptions bound to an image of a revision, for retrieval only. Saving one again changes nothing;
  another description under the same identity is a conflict. Only new hints count as a change (``save`` tells how many).

Rows carry the epoch that they were saved at; a vector that is replaced keeps the epoch of the first. A read as of an
epoch gives what was there by then (replaced vectors with their present values).

Defined results: null keys are refused; an empty batch changes nothing; a store without rows reads as an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import identity
from lectern.functions.vectors import valid
from lectern.sources.catalogue_store import Conflict, refuse
from lectern.sources.scratch import stored

DOCUMENT = ["document_id", "revision"]
VECTOR_KEYS = [*DOCUMENT, "element_id"]
VECTORS = "document_id string, revision string, element_id string, vector array<double>, epoch bigint, space_key string, bucket int"
#: Folders of a space; a document is in one of them. Fixed when a store is made.
BUCKETS = 16
HINTS = "id string, document_id string, revision string, source_hash string, image_id string, blob_hash string, model_fingerprint string, prompt_fingerprint string, description string, description_hash string, authority string, epoch bigint"
BINDING = ["document_id", "revision", "source_hash", "image_id", "blob_hash", "model_fingerprint", "prompt_fingerprint"]


def opened(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bucket(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.hash(document_id.cast("string")), F.lit(buckets))


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, f"{root.rstrip('/')}/vectors", buckets

    def save(self, rows: DataFrame, space_key: str, dimension: int, active: DataFrame, epoch: int) -> None:
        """rows: (document_id, revision, element_id, vector)."""
        own = stored(rows.select(*VECTOR_KEYS, "vector"), "vectors-new")  # a provider's vectors are made once
        bad = own.where(~F.coalesce(valid("vector") & (F.size("vector") == dimension), F.lit(False)) | F.greatest(*[F.col(k).isNull() for k in VECTOR_KEYS]))
        refuse(bad, "a vector of another dimension, not finite or zero, or a null key")
        refuse(own.groupBy(*VECTOR_KEYS).count().where("count > 1"), "an element comes twice")
        refuse(own.join(active, DOCUMENT, "left_anti"), "vectors of a revision that is not active")
        own = own.withColumn("bucket", bucket(F.col("document_id"), self.buckets))
        touched = [r[0] for r in own.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        before = self._all(space_key).where(F.col("bucket").isin(touched))
        kept = before.join(own.select(*VECTOR_KEYS), VECTOR_KEYS, "left_anti")
        first = before.select(*VECTOR_KEYS, F.col("epoch").alias("first"))
        added = own.join(first, VECTOR_KEYS, "left").withColumn("epoch", F.coalesce("first", F.lit(epoch).cast("bigint"))).drop("first").withColumn("space_key", F.lit(space_key))
        columns = [c.split()[0] for c in VECTORS.split(", ")]
        # the folders that are read are replaced, so the rows are put elsewhere first
        whole = stored(kept.select(*columns).unionByName(added.select(*columns)), "vectors-merged")
        order = ["bucket", *VECTOR_KEYS]
        ranged = whole.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("space_key", "bucket").parquet(self.path)

    def _all(self, space_key: str) -> DataFrame:
        return opened(self.spark, self.path, VECTORS).where(F.col("space_key") == space_key)

    def read(self, space_key: str, epoch: int | None = None) -> DataFrame:
        """The vectors of one space; only its folder is read."""
        own = self._all(space_key)
        return (own if epoch is None else own.where(F.col("epoch") <= epoch)).select(*VECTOR_KEYS, "vector")

    def document(self, space_key: str, document_id: str, revision: str) -> DataFrame:
        """One document's (element_id, vector): one folder, and of its files the row groups with this document."""
        own = self._all(space_key).where(F.col("bucket") == bucket(F.lit(document_id), self.buckets))
        return own.where((F.col("document_id") == document_id) & (F.col("revision") == revision)).select("element_id", "vector")

    def missing(self, elements: DataFrame, space_key: str) -> DataFrame:
        """Elements (document_id, revision, element_id, ...) without a vector: what is still to be indexed."""
        return elements.join(self.read(space_key), VECTOR_KEYS, "left_anti")


def identified(hints: DataFrame) -> DataFrame:
    """Hints (the binding columns and description) with id, description_hash and authority."""
    return hints.withColumn("id", identity.hint_id(*[F.col(c) for c in BINDING])).withColumn("description_hash", F.sha2("description", 256)).withColumn("authority", F.lit("retrieval-only"))


class HintStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/hints"

    def read(self, epoch: int | None = None) -> DataFrame:
        rows = opened(self.spark, self.path, HINTS)
        return rows if epoch is None else rows.where(F.col("epoch") <= epoch)

    def active(self, active: DataFrame, epoch: int | None = None) -> DataFrame:
        return self.read(epoch).join(active, DOCUMENT, "left_semi")

    def save(self, hints: DataFrame, epoch: int = 0) -> int:
        """Returns how many were new."""
        own = identified(hints).withColumn("epoch", F.lit(epoch).cast("bigint")).select(*[c.split()[0] for c in HINTS.split(", ")]).distinct()
        told = own.groupBy("id").agg(F.min("description_hash").alias("low"), F.max("description_hash").alias("high"))
        both = told.join(self.read().select("id", "description_hash"), "id", "left")
        if both.where("low <> high or description_hash <> low").limit(1).count():
            raise Conflict("another description under the same identity")
        new = stored(own.join(self.read().select("id"), "id", "left_anti"), "hints-new")
        count = new.count()
        if count:
            new.write.mode("append").parquet(self.path)
        return count
