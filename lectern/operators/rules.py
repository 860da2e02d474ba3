"""Integrity rules as tables of violations (code, key): one row for each broken rule and row, none where all is well.

Rules that look at one row are filters, which need no shuffle; budgets and identities group by document. A commit may
refuse a capture when its violations are not empty (``sources.catalogue_store.refuse``).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import utf16_length

# Forms of identifiers, kinds of origin, limits.
HASH, DOCUMENT, IDENTIFIER = "^[a-f0-9]{64}$", "^doc_[a-f0-9]{64}$", "^[A-Za-z0-9_-]{1,128}$"
ORIGINS = ("standalone_original", "embedded_original", "decoded_embedded", "page_render", "page_crop")


@dataclass(frozen=True)
class Limits:
    elements: int = 5000
    images: int = 100
    label: int = 1000
    parser: int = 200
    text: int = 100_000
    total: int = 2_000_000
    caption: int = 100_000
    anchor: int = 1000


def broken(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """A row (code, key) for each rule that does not hold for a row; null counts as not holding."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in rules.items()]))
    return rows.select(F.explode(codes).alias("code"), F.col(key).cast("string").alias("key"))


def united(*tables: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def counted(violations: DataFrame) -> DataFrame:
    return violations.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def locator(limits: Limits) -> Column:
    """Whether (kind, page, start, stop, anchor) is a place."""
    page = (F.col("kind") == "page") & (F.col("page") > 0)
    lines = (F.col("kind") == "lines") & (F.col("start") > 0) & (F.col("stop") >= F.col("start"))
    anchor = (F.col("kind") == "anchor") & (utf16_length(F.col("anchor")) <= limits.anchor)
    return F.coalesce(page, F.lit(False)) | F.coalesce(lines, F.lit(False)) | F.coalesce(anchor, F.lit(False))


def capture_rules(documents: DataFrame, elements: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """documents: (document_id, source_hash, label, parser); elements: (document_id, element_id, text, locator columns);
    images: (document_id, image_id, blob_hash, caption, origin, element_ids, locator columns)."""
    length = lambda c: utf16_length(F.col(c))
    heads = broken(documents, "document_id", document_id=F.col("document_id").rlike(DOCUMENT), source_hash=F.col("source_hash").rlike(HASH), label=length("label") <= limits.label, parser=length("parser") <= limits.parser)
    items = elements.select("document_id", F.col("element_id").alias("id"), locator(limits).alias("placed")).unionByName(images.select("document_id", F.col("image_id").alias("id"), locator(limits).alias("placed")))
    ids = broken(items, "id", identifier=F.col("id").rlike(IDENTIFIER), locator=F.col("placed"))
    twice = items.groupBy("document_id", "id").count().where("count > 1").select(F.lit("duplicate").alias("code"), F.col("id").alias("key"))
    sizes = elements.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(length("text")).alias("total"))
    budgets = broken(sizes, "document_id", elements=F.col("n") <= limits.elements, text_budget=F.coalesce("total", F.lit(0)) <= limits.total)
    many = broken(images.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", images=F.col("n") <= limits.images)
    texts = broken(elements, "element_id", text=length("text") <= limits.text)
    own = broken(images, "image_id", image=F.col("blob_hash").rlike(HASH) & (length("caption") <= limits.caption) & F.col("origin").isin(*ORIGINS) & (F.size("element_ids") <= limits.elements))
    linked = images.select("document_id", "image_id", F.explode("element_ids").alias("element_id"))
    unknown = linked.join(elements.select("document_id", "element_id"), ["document_id", "element_id"], "left_anti").select(F.lit("unknown_element").alias("code"), F.col("image_id").alias("key"))
    return united(heads, ids, twice, budgets, many, texts, own, unknown)


def ocr_rules(elements: DataFrame, images: DataFrame) -> DataFrame:
    """Of OCR captures: pages come once each from 1 on, every page has elements, and their transcripts lie end to end.

    elements: (document_id, page, start, stop, text); images: (document_id, page), one render for each page.
    """
    pages = images.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages"), F.min("page").alias("low"), F.max("page").alias("high"))
    sequence = broken(pages, "document_id", page_sequence=(F.col("n") == F.col("pages")) & (F.col("low") == 1) & (F.col("high") == F.col("n")))
    keys = ["document_id", "page"]
    bare = images.join(elements.select(*keys).distinct(), keys, "left_anti").select(F.lit("page_without_text").alias("code"), F.col("document_id").cast("string").alias("key"))
    stray = elements.join(images.select(*keys).distinct(), keys, "left_anti").select(F.lit("text_without_page").alias("code"), F.col("document_id").cast("string").alias("key"))
    # end to end: the lengths of a page's parts add up to its end, and no two begin at one place
    size = utf16_length(F.col("text"))
    whole = elements.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"), F.max("stop").alias("last"), F.min("start").alias("first"), F.countDistinct("start").alias("starts"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("stop") - F.col("start") != size, 1).otherwise(0)).alias("wrong"))
    lying = broken(whole, "document_id", transcript=(F.col("first") == 0) & (F.col("covered") == F.col("last")) & (F.col("starts") == F.col("n")) & (F.col("wrong") == 0))
    return united(sequence, bare, stray, lying)


def hint_rules(hints: DataFrame, images: DataFrame, most: int = 16_000) -> DataFrame:
    """hints: (image_id, description); images: (image_id): sizes of descriptions and bindings."""
    own = broken(hints, "image_id", long_description=utf16_length(F.coalesce("description", F.lit(""))) <= most, empty_description=F.trim("description") != "")
    unbound = hints.join(images, "image_id", "left_anti").select(F.lit("unknown_image").alias("code"), F.col("image_id").cast("string").alias("key"))
    return united(own, unbound)


def excerpt_stands(whole: Column, start: Column, stop: Column, text: Column) -> Column:
    """Whether ``text`` is what stands at ``start`` to ``stop`` of ``whole``, in UTF-16 code units."""
    units = F.encode(whole, "UTF-16BE")
    return F.substring(units, 2 * start + 1, 2 * (stop - start)) == F.encode(text, "UTF-16BE")


def stale_evidence(texts: DataFrame, figures: DataFrame, documents: DataFrame, elements: DataFrame, images: DataFrame) -> DataFrame:
    """What of a bundle is no longer what the catalogue's snapshot has: (code, key); an answer's context is built only without any.

    texts: (id, document_id, revision, element_id, start, stop, text, text_hash); figures: (id, document_id, revision,
    image_id, blob_hash); documents: (document_id, revision), the active ones; elements: (document_id, element_id, text);
    images: (document_id, image_id, blob_hash). A row may break several rules; null places and texts break theirs.
    """
    active = documents.select("document_id", F.col("revision").alias("now"))
    own = texts.join(active, "document_id", "left").join(elements.select("document_id", "element_id", F.col("text").alias("whole")), ["document_id", "element_id"], "left")
    placed = (F.col("start") >= 0) & (F.col("stop") > F.col("start")) & excerpt_stands(F.col("whole"), F.col("start"), F.col("stop"), F.col("text"))
    of_texts = broken(own, "id", text_revision=F.col("now") == F.col("revision"), text_place=placed, text_hash=F.col("text_hash") == F.sha2("text", 256))
    now = figures.join(active, "document_id", "left").join(images.select("document_id", "image_id", F.col("blob_hash").alias("stored")), ["document_id", "image_id"], "left")
    return united(of_texts, broken(now, "id", figure_revision=F.col("now") == F.col("revision"), figure_image=F.col("stored") == F.col("blob_hash")))


def verdict(violations: DataFrame, vectors: DataFrame, unverified: DataFrame | None = None, most: int = 100) -> DataFrame:
    """(code, n, examples, verdict): all rule tables' violations by code, at most ``most`` keys of each (the smallest), and what they mean.

    A collection with any violation has failed; without one it is incomplete while it has vectors (they can't be checked
    without their model) or rows that nobody verified, else passed. A row without a code stands for a collection without
    violations. Violations are read once; the keys of a code are ranked in its tasks before they meet.
    """
    order = Window.partitionBy("code").orderBy("key")
    ranked = violations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    shown = ranked.groupBy("code").agg(F.array_sort(F.collect_list("key")).alias("examples"))
    found = counted(violations).join(shown, "code")
    left = [t.select(F.lit(1).alias("x")).limit(1) for t in (vectors, unverified) if t is not None]
    open_ = functools.reduce(DataFrame.unionByName, left).agg((F.count(F.lit(1)) > 0).alias("open"))
    all_ = found.agg(F.count(F.lit(1)).alias("codes")).join(F.broadcast(open_))  # tables of one row each
    said = F.when(F.col("codes") > 0, "failed").when(F.col("open"), "incomplete").otherwise("passed")
    return all_.select(said.alias("verdict")).join(found, how="left", on=F.lit(True)).select("code", F.coalesce("n", F.lit(0)).alias("n"), "examples", "verdict")


def evidence_rules(texts: DataFrame, elements: DataFrame, blocks: DataFrame, figures: DataFrame, most: int = 100) -> DataFrame:
    """A bundle's references, hashes and offsets.

    texts: (bundle_id, id, element_id, text, text_hash, start, stop); elements: (element_id, text); blocks: (bundle_id,
    block, kind, occurrence_id, evidence_ids); figures: (bundle_id, id).
    """
    size = utf16_length(F.col("text"))
    own = broken(texts, "id", text_hash=F.col("text_hash") == F.sha2("text", 256), offsets=(F.col("start") >= 0) & (F.col("stop") - F.col("start") == size))
    keys = ["bundle_id", "id"]
    twice = texts.select(*keys).unionByName(figures.select(*keys)).groupBy(*keys).count().where("count > 1").select(F.lit("duplicate").alias("code"), F.col("id").alias("key"))
    many = broken(texts.groupBy("bundle_id").count(), "bundle_id", texts=F.col("count") <= most)
    # an excerpt has to stand in its element where it says
    held = texts.join(elements.select("element_id", F.col("text").alias("whole")), "element_id", "left")
    excerpt = broken(held, "id", excerpt=excerpt_stands(F.col("whole"), F.col("start"), F.col("stop"), F.col("text")))
    bare = broken(blocks, "bundle_id", block_without_evidence=F.size("evidence_ids") > 0)
    used = blocks.select("bundle_id", F.explode("evidence_ids").alias("id"))
    unknown = used.join(texts.select(*keys), keys, "left_anti").select(F.lit("unknown_evidence").alias("code"), F.col("id").alias("key"))
    shown = blocks.where("kind = 'figure'").select("bundle_id", F.col("occurrence_id").alias("id"))
    lost = shown.join(figures.select(*keys), keys, "left_anti").select(F.lit("unknown_figure").alias("code"), F.col("id").alias("key"))
    return united(own, twice, many, excerpt, bare, unknown, lost)


def export_closure(blocks: DataFrame, texts: DataFrame, figures: DataFrame, sources: DataFrame) -> DataFrame:
    """(bundle_id, kind, id): the texts, figures and sources that a bundle's blocks use, and nothing else.

    texts and figures: (bundle_id, id, source_id); sources: (id).
    """
    keys = ["bundle_id", "id"]
    used = blocks.select("bundle_id", F.explode("evidence_ids").alias("id")).distinct()
    shown = blocks.where("kind = 'figure'").select("bundle_id", F.col("occurrence_id").alias("id")).distinct()
    own = texts.join(used, keys, "left_semi").select(*keys, "source_id", F.lit("text").alias("kind"))
    both = own.unionByName(figures.join(shown, keys, "left_semi").select(*keys, "source_id", F.lit("figure").alias("kind")))
    origin = both.select("bundle_id", F.col("source_id").alias("id")).distinct().join(sources.select("id"), "id", "left_semi")
    return both.select("bundle_id", "kind", "id").unionByName(origin.select("bundle_id", F.lit("source").alias("kind"), "id"))


def audit(revisions: DataFrame, active: DataFrame, hints: DataFrame, vectors: DataFrame, blobs: DataFrame, images: DataFrame) -> DataFrame:
    """One row: counts of revisions, active and inactive ones, hints, vectors, blobs and orphans, and the verdict.

    revisions: (document_id, revision, source_hash); active: (document_id, revision); hints and vectors: (document_id,
    revision); blobs: (hash, ok); images: (blob_hash). A blob that fails its hash or a pointer to no revision fails the
    collection; orphans do not; stored vectors leave it incomplete, as they cannot be checked without their model.
    """
    keys = ["document_id", "revision"]
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    used = images.select(F.col("blob_hash").alias("hash")).unionByName(revisions.select(F.col("source_hash").alias("hash"))).distinct()
    parts = [
        size(revisions, "revisions"), size(active, "active"), size(revisions.join(active, keys, "left_anti"), "inactive"), size(active.join(revisions, keys, "left_anti"), "dangling"), size(hints, "hints"),
        size(hints.join(revisions, keys, "left_anti"), "unbound_hints"), size(vectors, "vectors"), size(blobs, "blobs"), size(blobs.join(used, "hash", "left_anti"), "orphans"), size(blobs.where("not ok"), "corrupt"),
    ]
    row = functools.reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # tables of one row each
    failed = (F.col("dangling") + F.col("unbound_hints") + F.col("corrupt")) > 0
    return row.withColumn("verdict", F.when(failed, "failed").when(F.col("vectors") > 0, "incomplete").otherwise("passed"))
