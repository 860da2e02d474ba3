"""Identities: SHA-256 over canonical JSON arrays of fields in a fixed order (null stays null in them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*fields: Column) -> Column:
    """SHA-256 of the JSON array of the fields as strings."""
    return F.sha2(F.to_json(F.array(*[f.cast("string") for f in fields])), 256)


def space_key(*fields: Column) -> Column:
    """Of an embedding space: its fields, the metric and the version of the text."""
    return hashed(*fields, F.lit("cosine"), F.lit("text-v1"))


def embedding_identity(space: Column, model_revision: Column, instruction: Column) -> Column:
    return hashed(F.lit("embedding-v1"), space, model_revision, instruction)


def capture_revision(source_hash: Column, parser: Column, elements: Column, images: Column) -> Column:
    """``elements`` and ``images``: arrays in order, taken as JSON."""
    return F.sha2(F.concat_ws("\n", source_hash, parser, F.to_json(elements), F.to_json(images)), 256)


def hint_id(*binding: Column) -> Column:
    """The description is left out, so that a second one for the same derivation is a conflict."""
    return F.concat(F.lit("hint_"), hashed(F.lit("vision-hint-v1"), *binding))


def batch_binding(book: Column, window_start: Column, offset: Column, texts: Column) -> Column:
    """What a batch of vectors was computed from: its place and its texts in order."""
    return hashed(F.lit("batch-v1"), book, window_start, offset, F.sha2(F.array_join(texts, "\u0000"), 256))


def vision_fingerprints(model: Column, prompt: Column) -> tuple[Column, Column]:
    return hashed(F.lit("vision-model-v1"), model), hashed(F.lit("vision-prompt-v1"), prompt)


def reranker_fingerprint(endpoint: Column, model: Column) -> Column:
    return hashed(F.lit("reranker-v1"), endpoint, model)


def text_id(source: Column, element: Column) -> Column:
    return F.concat(F.lit("text_"), F.sha2(F.concat(source, element), 256))


def figure_id(source: Column, image: Column) -> Column:
    return F.concat(F.lit("figure_"), F.sha2(F.concat(source, image), 256))
