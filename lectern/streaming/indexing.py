"""The index phase as a second stream: what the catalogue has committed goes in, vectors come out.

The stream reads the catalogue's committed pointers (document, revision, folder), so it is chained to whatever publishes;
its checkpoint is the cursor. A micro-batch takes at most ``max_files`` files of pointers. Of the revisions in them that are
still active, the elements are dealt, in order, into batches of ``jobs.BATCH``; each batch is one bounded call of the
provider, and its vectors are kept with a binding: the hash of space, document, revision, place and texts.

A micro-batch is committed as one folder named by its number, written in place of what an earlier try of that number
left there, so it is stored once however often Spark repeats it. A batch that is stored under its binding already (a
revision that is published again) is not computed again. What a failure can cost is the micro-batch that it happens in.

Defined results: an element without text counts as empty; removals are skipped; a document without elements has no batch;
an empty catalogue makes no call; pointers of an epoch without its mark of completion fail the stream, which finds them again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import identity
from lectern.operators import embedding, jobs
from lectern.sources.catalogue_store import ACTIVE, KEYS, CatalogueStore, Conflict

BATCHES = "document_id string, revision string, ordinal bigint, positions array<int>, binding string, vectors array<array<double>>, space string, commit string"
BATCH_KEYS = [*KEYS, "ordinal", "binding"]


def planned(elements: DataFrame, space: Column, size: int = jobs.BATCH) -> DataFrame:
    """(document_id, revision, ordinal, positions, texts, binding): a revision's elements in batches, numbered from 0.

    elements: (document_id, revision, pos, text), pos from 0 without gaps.
    """
    own = elements.select(*KEYS, F.floor(F.col("pos") / size).alias("ordinal"), F.struct("pos", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    grouped = own.groupBy(*KEYS, "ordinal").agg(F.array_sort(F.collect_list("e")).alias("e"))  # ``size`` elements at most
    texts = F.transform("e", lambda e: e["text"])
    binding = identity.batch_binding(F.concat_ws("\n", space, "document_id"), F.col("revision"), F.col("ordinal"), texts)
    return grouped.select(*KEYS, "ordinal", F.transform("e", lambda e: e["pos"]).alias("positions"), texts.alias("texts"), binding.alias("binding"))


class VectorIndex:
    def __init__(self, store: CatalogueStore, root: str, space: embedding.Space, provider: embedding.Provider) -> None:
        self.store, self.root, self.space, self.provider = store, root.rstrip("/"), space, provider

    def _key(self) -> Column:
        return identity.hashed(F.lit(self.space.key()))

    def batches(self) -> DataFrame:
        """The stored batches of this space; its folder alone is read."""
        try:
            rows = self.store.spark.read.schema(BATCHES).parquet(f"{self.root}/batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.store.spark.createDataFrame([], BATCHES)
        return rows.where(F.col("space") == self._key())

    def vectors(self) -> DataFrame:
        """(document_id, revision, pos, vector)."""
        each = self.batches().select(*KEYS, F.explode(F.arrays_zip("positions", "vectors")).alias("x"))
        return each.select(*KEYS, F.col("x.positions").alias("pos"), F.col("x.vectors").alias("vector"))

    def commit(self, pointers: DataFrame, number: int, name: str) -> None:
        """Compute and store the batches of one micro-batch of pointers."""
        ready = self.store.epochs()
        if pointers.where(~F.col("epoch").isin(ready) if ready else F.lit(True)).limit(1).count():
            raise Conflict("pointers of an epoch that is not complete")
        new = pointers.where("revision is not null").select(*KEYS, "part").join(self.store.active(), [*KEYS, "part"], "left_semi").distinct()
        rows = self.store.rows().join(new, [*KEYS, "part"], "left_semi")
        todo = planned(rows, self._key()).join(self.batches().where(F.col("commit") != f"{name}-{number}"), BATCH_KEYS, "left_anti")
        found = embedding.embedded_batches(todo, self.space, self.provider).withColumn("space", self._key()).withColumn("commit", F.lit(f"{name}-{number}"))
        # the folder of this number alone is replaced
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("space", "commit").parquet(f"{self.root}/batches")

    def run(self, checkpoint: str, name: str = "index", max_files: int = 1) -> None:
        """Index all that is committed and not indexed yet; a stopped run is taken up where it ended."""
        spark = self.store.spark
        pointers = spark.readStream.schema(f"{ACTIVE}, epoch bigint").option("maxFilesPerTrigger", max_files).parquet(f"{self.store.root}/active")
        commit = lambda rows, number: self.commit(rows.where("document_id is not null"), number, name)
        pointers.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def progress(self) -> DataFrame:
        """(document_id, revision, batches, stored, state): ``ready`` when all batches of an active revision are stored, else ``indexing`` or ``parsed``."""
        plan = planned(self.store.snapshot(), self._key()).select(*BATCH_KEYS)
        have = self.batches().select(*BATCH_KEYS).distinct().withColumn("have", F.lit(1))
        per = plan.join(have, BATCH_KEYS, "left").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("batches"), F.count("have").alias("stored"))
        return per.withColumn("state", F.when(F.col("stored") == F.col("batches"), "ready").when(F.col("stored") > 0, "indexing").otherwise("parsed"))
