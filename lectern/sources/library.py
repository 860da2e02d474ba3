"""A catalogue with its vectors and hints under one epoch.

A publication, a removal and new hints raise the epoch; vectors don't, but are refused when the epoch is not the one that
they were computed at. ``snapshot`` reads all three as of one epoch: the active revisions then, the vectors of one space
and the hints that were bound to them by then. ``dispatched`` runs work that was planned at an epoch, and refuses it when
the epoch has moved before the work starts or by the time it ends, so that nothing stale is committed.

Defined results: an empty library is at epoch 0, with empty tables; hints that are all known change nothing, the epoch
neither; rows of a snapshot are tables, in the order of their ids where ``ordered`` asks for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.catalogue_store import CatalogueStore, Conflict
from lectern.sources.retrieval_store import DOCUMENT, HintStore, VectorStore

Result = TypeVar("Result")


@dataclass(frozen=True)
class Snapshot:
    epoch: int
    documents: DataFrame  # document_id, revision
    elements: DataFrame
    vectors: DataFrame | None
    hints: DataFrame

    def ordered(self) -> Snapshot:
        """Documents by document_id, hints by id."""
        return Snapshot(self.epoch, self.documents.orderBy("document_id"), self.elements, self.vectors, self.hints.orderBy("id"))


class Library:
    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        root = root.rstrip("/")
        self.catalogue, self.vectors, self.hints = CatalogueStore(spark, f"{root}/catalogue", schema), VectorStore(spark, root), HintStore(spark, root)

    def snapshot(self, space_key: str | None = None, epoch: int | None = None) -> Snapshot:
        at = self.catalogue.epoch() if epoch is None else epoch
        active = self.catalogue.active(at).select(*DOCUMENT)
        vectors = None if space_key is None else self.vectors.read(space_key, at).join(active, DOCUMENT, "left_semi")
        return Snapshot(at, active, self.catalogue.snapshot(at), vectors, self.hints.active(active, at))

    def check(self, epoch: int) -> None:
        found = self.catalogue.epoch()
        if found != epoch:
            raise Conflict(f"sources changed: planned at epoch {epoch}, now {found}; retry")

    def dispatched(self, epoch: int, work: Callable[[], Result]) -> Result:
        self.check(epoch)
        result = work()
        self.check(epoch)
        return result

    def save_vectors(self, rows: DataFrame, space_key: str, dimension: int, epoch: int) -> None:
        """Vectors computed from the snapshot at ``epoch``."""
        self.check(epoch)
        self.vectors.save(rows, space_key, dimension, self.catalogue.active(epoch).select(*DOCUMENT), epoch)

    def save_hints(self, hints: DataFrame, epoch: int) -> int:
        """Returns the epoch: a new one if a hint was new. Hints count from then on."""
        self.check(epoch)
        return self.catalogue.touch(epoch) if self.hints.save(hints, epoch + 1) else epoch
