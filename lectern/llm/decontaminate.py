"""Operator 8: benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window). The shingles of a window are its pairs
of neighbouring words (a window of one word has that word), ordered by rarity over the whole corpus; as a window must be
contained whole, the prefix that a document has to share is one shingle, the rarest. Document positions of prefix
shingles join the windows on the shingle, bounds on position and length drop windows that would leave the text, and the
words are compared one by one.

The windows' tables are broadcast only when their rows, of which each holds its words, take at most ``BROADCAST_BYTES``. Beyond that the same joins
shuffle (document, position, shingle) rows, and only documents with a candidate are looked up for their words; either
way the result is the same. Shingles are hashed for the joins, equality rests on the words.

Defined results: null and empty texts have no words and are clean; items without words have no window; repeated
documents keep a row each (equal text, equal result), repeated items count once by item_id; a null item_id is not
counted; empty tables give clean rows or none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, text_or_empty

WINDOW = 10
BROADCAST_BYTES = 64 << 20
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    return F.filter(F.split(ascii_lower(text_or_empty(text)), SEPARATOR), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words), each once."""
    own = benchmark.where("item_id is not null").select("item_id", words().alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return own.select("item_id", F.explode(starts).alias("from"), "w").select("item_id", F.slice("w", F.col("from") + 1, F.lit(size)).alias("words")).distinct()


def shingled(rows: DataFrame, words_: str, *keys: str, single: bool) -> DataFrame:
    """The keys, ``at`` and ``shingle`` of each pair of neighbouring words; with ``single`` of each word too."""
    pairs = F.arrays_zip(F.col(words_).alias("one"), F.slice(words_, 2, F.greatest(F.size(words_), F.lit(1))).alias("two"))
    each = rows.select(*keys, F.posexplode(pairs).alias("at", "p"))
    pair = F.when(F.col("p.two").isNotNull(), F.xxhash64("p.one", "p.two"))
    if not single:
        return each.select(*keys, "at", pair.alias("shingle")).where("shingle is not null")
    both = F.array_compact(F.array(F.xxhash64("p.one"), pair))
    return each.select(*keys, "at", F.explode(both).alias("shingle"))


def prefixes(documents: DataFrame, window: DataFrame, small: bool, single: bool) -> DataFrame:
    """(shingle, before, item_id, window): each window under its rarest shingle, which stands ``before`` words into it."""
    hint = F.broadcast if small else lambda df: df
    own = shingled(window, "words", "item_id", "words", single=single).where("size(words) = 1 or shingle <> xxhash64(words[at])")
    vocabulary = own.select("shingle").distinct()
    corpus = shingled(documents.select(words().alias("w")), "w", single=single).select("shingle")
    count = lambda df: df.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    # where the vocabulary cannot be broadcast, counts are made before it is joined, so that frequent shingles are few rows
    seen = count(corpus.join(hint(vocabulary), "shingle", "left_semi")) if small else count(corpus).join(vocabulary, "shingle", "left_semi")
    placed = own.join(hint(seen), "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("r")
    return placed.groupBy("item_id", "words").agg(rarest).select(F.col("r.shingle").alias("shingle"), F.col("r.at").alias("before"), "item_id", F.col("words").alias("window"))


def occurrences(documents: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(key, text_key, item_id, start, stop): the places of windows in the texts of ``documents`` (key, text_key, text)."""
    window = windows(benchmark, size)
    # a row of the prefix table: its fixed part, a place and the padded bytes of each word
    row = 64 + 16 * F.size("words") + F.octet_length(F.array_join("words", ""))
    held, single = window.agg(F.sum(row), F.max(F.size("words") == 1)).first()
    small, single = (held or 0) <= BROADCAST_BYTES, bool(single)
    prefix = prefixes(documents, window, small, single)
    split = documents.select("key", "text_key", words().alias("w")).where(F.size("w") > 0)
    first, length = F.col("at") - F.col("before"), F.size("window")
    same = F.slice("w", F.greatest(first, F.lit(0)) + 1, length) == F.col("window")
    if small:
        near = shingled(split, "w", "key", "text_key", "w", single=single).join(F.broadcast(prefix), "shingle").where((first >= 0) & (first + length <= F.size("w")))
    else:
        sized = split.withColumn("n", F.size("w"))
        near = shingled(sized, "w", "key", "text_key", "n", single=single).join(prefix, "shingle").where((first >= 0) & (first + length <= F.col("n")))
        texts = split.dropDuplicates(["key", "text_key"])
        near = near.select("key", "text_key", "at", "before", "item_id", "window").distinct().join(texts, ["key", "text_key"])
    return near.where(same).select("key", "text_key", "item_id", first.alias("start"), (first + length).alias("stop"))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted as strings): a row for each row of ``documents``."""
    key = [F.coalesce("doc_id", F.lit(-1)).alias("key"), F.xxhash64(text_or_empty()).alias("text_key")]
    found = occurrences(documents.select(*key, "text"), benchmark, size)
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('n', 0L, 'reach', 0), (s, x) -> named_struct("
        "'n', s.n + greatest(0, x.stop - greatest(x.start, s.reach)), 'reach', greatest(s.reach, x.stop)), s -> s.n)"
    )
    hits = found.groupBy("key", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    hits = hits.select("key", "text_key", covered.alias("n_hit"), F.array_sort("items").alias("items"))
    base = documents.select("doc_id", *key, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("n_words"))
    return base.join(hits, ["key", "text_key"], "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` in which no window occurs, unchanged."""
    dirty = contamination(documents, benchmark, size).where("n_hit > 0").select(F.coalesce("doc_id", F.lit(-1)).alias("dirty_id"), F.col("text_key").alias("dirty_key"))
    same = (F.coalesce(documents["doc_id"], F.lit(-1)) == dirty["dirty_id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == dirty["dirty_key"])
    return documents.join(dirty, same, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
grams AS (SELECT r, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT r, i, k, item_id FROM grams JOIN win USING (g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
