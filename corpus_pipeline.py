"""From raw documents to packed training sequences, in five stages.

Each stage takes the Parquet that its predecessor wrote, and its decisions take effect:

1. language_id: documents without a letter, or whose language is less likely than ``MIN_LANGUAGE_SCORE``, go.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: of documents linked by five-word shingles at a similarity of 0.8, the smallest doc_id stays.
4. decontamination: documents in which ten consecutive words of a benchmark item occur go.
5. packing: what is left, as pieces of sequences of at most 1024 tokens (the columns of the packing query).

Defined results: null and empty texts, and those without a letter, go in the first stage; rows that repeat stay or go
together; a null doc_id loses against any other copy; an empty table gives no sequence; other columns pass through to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from lectern.llm.common import stored, table

MIN_LANGUAGE_SCORE = 0.4
#: Bytes of text that a packing task encodes at once, what it looks up and remembers in proportion: the executors' heaps have grown by the stages before.
ENCODED_TOGETHER = 1 << 20


def free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(free_name(n, docs.columns) for n in ("predicted", "likely"))
    predicted = language_id.predict(docs, language_id.fit(docs), names=names)
    return predicted.where((F.col(names[0]) != "und") & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.placed(packing.pack(docs, together=ENCODED_TOGETHER))


STAGES = [("language_id", keep_known_languages), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can't express the trained language model of the first stage; a test compares each stage and run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
