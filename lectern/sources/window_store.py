"""Windows of books as checked records, committed by number and read under a byte budget.

A window is a few pages' elements as one JSON record with its size and SHA-256. ``save`` writes one commit as a folder of
its own, in place of what an earlier try of that commit left. Reads look at sizes first: the columns ``book_id`` and
``size`` alone say whether a book is beyond the budget, and no payload of a refused read is fetched. What takes windows one
by one, as Spark's tasks do, holds a record at a time and has no such budget (``windows``). A payload whose bytes don't match
its checksum, or that is no such JSON, fails the read.

Defined results: a record beyond ``RECORD`` bytes is refused, and so is a window that is stored already by another commit;
null texts count as empty; a window without elements is a record like the rest; an empty store reads as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.catalogue_store import refuse
from lectern.sources.retrieval_store import opened
from lectern.sources.scratch import discard, stored

# The most bytes of a record, and of what one read of a book may hold.
RECORD, BUDGET = 2 << 20, 64 << 20
KEYS = ["book_id", "window_no"]
ELEMENT = "array<struct<pos:int,page:bigint,text:string>>"
ROWS = "book_id string, window_no bigint, payload string, size bigint, checksum string, commit string"


class OverBudget(RuntimeError):
    pass


class WindowStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/windows"

    def _rows(self) -> DataFrame:
        return opened(self.spark, self.path, ROWS)

    def save(self, windows: DataFrame, commit: str) -> None:
        """windows: (book_id, window_no, elements), elements with pos, page and text."""
        element = lambda e: F.struct(e["pos"].cast("int").alias("pos"), e["page"].cast("long").alias("page"), F.coalesce(e["text"], F.lit("")).alias("text"))
        own = windows.select(F.col("book_id").cast("string").alias("book_id"), F.col("window_no").cast("long").alias("window_no"), F.to_json(F.transform("elements", element)).alias("payload"))
        # stored, as the checks and the writer would each compute the windows again
        own = stored(own.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("checksum")), "windows", compression="zstd")
        refuse(own.where(F.col("size") > RECORD), "a window beyond a record's bytes")
        refuse(own.groupBy(*KEYS).count().where("count > 1"), "a window comes twice")
        refuse(own.join(self._rows().where(F.col("commit") != commit).select(*KEYS), KEYS, "left_semi"), "a window is stored already")
        ordered = own.withColumn("commit", F.lit(commit)).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("commit").parquet(self.path)
        discard(own)

    def _of(self, books: list[str] | None) -> DataFrame:
        return self._rows() if books is None else self._rows().where(F.col("book_id").isin(books))

    def read(self, books: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
        """``windows`` for a reader that holds whole books; ``OverBudget`` where one of them is beyond the budget."""
        large = self._of(books).groupBy("book_id").agg(F.sum("size").alias("size")).where(F.col("size") > budget).take(1)
        if large:
            raise OverBudget(f"book {large[0]['book_id']} has {large[0]['size']} bytes, more than {budget}")
        return self.windows(books)

    def windows(self, books: list[str] | None = None) -> DataFrame:
        """(book_id, window_no, elements) of some books, or all, of any size: a row is a record, which alone is bounded."""
        rows = self._of(books)
        good = F.when(F.sha2("payload", 256) == F.col("checksum"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("window checksum mismatch: "), F.col("book_id"))))
        return rows.select(*KEYS, F.from_json(good, ELEMENT, {"mode": "FAILFAST"}).alias("elements"))
