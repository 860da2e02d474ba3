"""Generations of a book's vectors: built in the shadow of the active one, checked, activated, searched.

A generation holds the vectors of all of a set of books' batches (``jobs.BATCH`` elements of a window each, numbered over
the book) in one space. ``reindex`` adds one beside whatever is active: a folder of Parquet named by the generation;
``resume`` computes the batches that it still lacks, commit by commit. Each batch carries a binding, the hash of
generation, space, book, number, texts and vectors, that every read verifies: vectors that belong to other texts, or that
were changed, fail the read (``Drift`` in a check, an error of the job in a search).

Pointers are append-only: a row for each activation, with the book's epoch. An activation names the generation and epoch
that its caller saw and is taken only if both are current and the generation is valid (so going back and forth between two
generations is safe). A search reads the pointers once and stays with what they named.

Defined results: null texts count as empty; a book without elements has no batch, and its generation is valid; a book that
is not active has no hits; hits are ordered by score, then page, then element; an unknown generation is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import identity
from lectern.functions.vectors import cosine
from lectern.operators import embedding, fusion, jobs
from lectern.operators.search import checked
from lectern.sources.catalogue_store import Conflict, refuse
from lectern.sources.retrieval_store import opened
from lectern.sources.scratch import stored

KEYS = ["book_id", "ordinal"]
#: Decimal places to which scores are compared.
PLACES = 12
GENERATIONS = "generation string, space string"
BATCHES = "book_id string, ordinal bigint, vectors array<array<double>>, binding string, generation string, commit string"
POINTERS = "book_id string, generation string, epoch bigint"


class Drift(RuntimeError):
    """Stored vectors are not those of the texts as they are."""


def planned(elements: DataFrame, size: int = jobs.BATCH) -> DataFrame:
    """(book_id, ordinal, elements): batches numbered over each book, with their (pos, page, text).

    elements: (book_id, window_no, pos, page, text), pos from 0 in each window without gaps.
    """
    own = elements.select(F.col("book_id").cast("string").alias("book_id"), "window_no", F.floor(F.col("pos") / size).alias("batch"), F.struct("pos", "page", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    batches = own.groupBy("book_id", "window_no", "batch").agg(F.array_sort(F.collect_list("e")).alias("elements"))  # ``size`` elements at most
    windows = batches.groupBy("book_id", "window_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("book_id").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    base = windows.select("book_id", "window_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return batches.join(base, ["book_id", "window_no"]).select("book_id", (F.col("base") + F.col("batch")).alias("ordinal"), "elements")


class GenerationStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def space(self, generation: str) -> str:
        """The key of the space that a generation was made for."""
        rows = opened(self.spark, f"{self.root}/generations", GENERATIONS).where(F.col("generation") == generation).take(1)
        if not rows:
            raise Conflict(f"unknown generation {generation}")
        return rows[0]["space"]

    def stored(self, generation: str) -> DataFrame:
        """A generation's batches; its folder alone is read."""
        return opened(self.spark, f"{self.root}/vectors", BATCHES).where(F.col("generation") == generation)

    def _binding(self, generation: str | Column, space: str | Column) -> Column:
        own = [x if isinstance(x, Column) else F.lit(x) for x in (generation, space)]
        texts = F.sha2(F.to_json(F.transform("elements", lambda e: e["text"])), 256)
        return identity.hashed(F.lit("generation-v1"), *own, F.col("book_id"), F.col("ordinal"), texts, F.sha2(F.to_json("vectors"), 256))

    def reindex(self, generation: str, space: embedding.Space) -> None:
        """Open a new generation; nothing that is active changes."""
        known = opened(self.spark, f"{self.root}/generations", GENERATIONS)
        refuse(known.where(F.col("generation") == generation), f"generation {generation} exists")
        self.spark.createDataFrame([(generation, space.key())], GENERATIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/generations")

    def resume(self, generation: str, elements: DataFrame, space: embedding.Space, provider: embedding.Provider, commit: str) -> None:
        """Compute and store, as one commit, the batches of ``elements`` that the generation lacks."""
        if self.space(generation) != space.key():
            raise Conflict("model identity drift")
        todo = planned(elements).join(self.stored(generation).where(F.col("commit") != commit).select(*KEYS), KEYS, "left_anti")
        made = embedding.embedded_batches(todo.withColumn("texts", F.transform("elements", lambda e: e["text"])), space, provider)
        own = made.withColumn("binding", self._binding(generation, space.key())).drop("elements").withColumn("generation", F.lit(generation)).withColumn("commit", F.lit(commit))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "commit").parquet(f"{self.root}/vectors")

    def state(self, generation: str, elements: DataFrame) -> DataFrame:
        """(book_id, planned, stored, missing, foreign, drifted, valid): a generation against the books' texts as they are."""
        both = planned(elements).join(self.stored(generation).select(*KEYS, "vectors", "binding"), KEYS, "full_outer")
        bound = F.col("binding") == self._binding(generation, self.space(generation))
        have, want = F.col("binding").isNotNull(), F.col("elements").isNotNull()
        per = both.groupBy("book_id").agg(
            F.count_if(want).alias("planned"), F.count_if(have).alias("stored"), F.count_if(~have).alias("missing"), F.count_if(~want).alias("foreign"),
            F.count_if(have & want & ~F.coalesce(bound, F.lit(False))).alias("drifted"),
        )
        return per.withColumn("valid", F.col("missing") + F.col("foreign") + F.col("drifted") == 0)

    def pointers(self) -> DataFrame:
        """(book_id, generation, epoch): what is active; books that never were are not in it."""
        rows = opened(self.spark, f"{self.root}/pointers", POINTERS)
        return rows.groupBy("book_id").agg(F.max_by("generation", "epoch").alias("generation"), F.max("epoch").alias("epoch"))

    def activate(self, requests: DataFrame, elements: DataFrame) -> DataFrame:
        """(book_id, generation, taken, why) for each of ``requests`` (book_id, generation, expected, expected_epoch).

        One request a book at a time; ``expected`` is null and ``expected_epoch`` 0 for a book that was never active.
        """
        refuse(requests.groupBy("book_id").count().where("count > 1"), "several activations of a book at once")
        books = requests.select("book_id", "generation").distinct()
        valid = None
        for (g,) in books.select("generation").distinct().collect():  # the generations that are asked for
            own = elements.join(books.where(F.col("generation") == g).select("book_id"), "book_id", "left_semi")
            part = self.state(g, own).where("valid").select("book_id", F.lit(g).alias("generation"))
            valid = part if valid is None else valid.unionByName(part)
        if valid is None:
            return requests.select("book_id", "generation", F.lit(False).alias("taken"), F.lit(None).cast("string").alias("why"))
        now = self.pointers().select("book_id", F.col("generation").alias("now"), "epoch")
        met = requests.join(now, "book_id", "left").join(valid.withColumn("valid", F.lit(True)), ["book_id", "generation"], "left")
        current = F.col("now").eqNullSafe(F.col("expected")) & (F.coalesce("epoch", F.lit(0)) == F.col("expected_epoch"))
        why = F.when(~current, "moved").when(F.col("valid").isNull(), "not valid")
        found = stored(met.select("book_id", "generation", "expected_epoch", why.isNull().alias("taken"), why.alias("why")), "activations")
        found.where("taken").select("book_id", "generation", (F.col("expected_epoch") + 1).cast("bigint").alias("epoch")).write.mode("append").parquet(f"{self.root}/pointers")
        return found.drop("expected_epoch")

    def search(self, elements: DataFrame, query: str, limit: int, space: embedding.Space | None = None, provider: embedding.Provider | None = None) -> DataFrame:
        """(book_id, generation, epoch, page, pos, score, rank): the best hits of each active book, in its active generation.

        Lexical without a provider; with one, its space must be that of every generation that is searched. Bindings are
        verified in either case.
        """
        pinned = stored(self.pointers(), "pinned")  # read once; later activations don't touch this search
        spaces = opened(self.spark, f"{self.root}/generations", GENERATIONS)
        own = pinned.join(spaces, "generation")
        vector = None
        if provider is not None:
            refuse(own.where(F.col("space") != space.key()), "query model identity drift")
            (vector,) = embedding.called(provider, space, [checked(query, limit)], "query")
        checked(query, limit)
        active = [r[0] for r in pinned.select("generation").distinct().collect()]  # generations are few; their folders alone are read
        vectors = opened(self.spark, f"{self.root}/vectors", BATCHES).where(F.col("generation").isin(active) if active else F.lit(False))
        batches = planned(elements).join(own, "book_id").join(vectors.select("generation", *KEYS, "vectors", "binding"), ["generation", *KEYS], "left")
        bound = F.assert_true(F.col("binding").eqNullSafe(self._binding(F.col("generation"), F.col("space"))), F.lit("generation vector binding drift"))
        each = batches.where(bound.isNull()).select("book_id", "generation", "epoch", "ordinal", F.posexplode(F.arrays_zip("elements", "vectors")).alias("place", "x"))
        each = each.select("book_id", "generation", "epoch", "ordinal", "place", "x.elements.page", "x.elements.pos", F.col("x.elements.text").alias("text"), F.col("x.vectors").alias("vector"))
        similarity = F.lit(0.0) if vector is None else cosine(F.col("vector"), F.array(*[F.lit(v) for v in vector]))
        scored = each.withColumn("score", F.round(fusion.book_hybrid(query.strip(), F.col("text"), similarity), PLACES)).where("score <> 0")
        order = Window.partitionBy("book_id").orderBy(F.desc("score"), "page", "ordinal", "place")
        # the best of each task go before the shuffle, as the rank is bounded
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("book_id", "generation", "epoch", "page", "pos", "score", "rank")
