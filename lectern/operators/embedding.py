"""Calls of an embedding provider from tasks, bounded in size and checked before anything is written.

A provider is a function from the texts of one call to a reply ``{"model": ..., "data": [{"index": i, "embedding": [...]}]}``;
it runs in Spark's Python workers, on Arrow batches. A call has at most ``TEXTS`` texts and ``UNITS`` UTF-16 code units,
instruction included. A reply must be of the space's model, its rows must be numbered 0 to n - 1 (they come back in that
order, whatever their order in the reply), and every vector must have the space's dimension, finite numbers and one that
is not zero. A reply that breaks a rule fails the task with its reason (``BadReply``), so the job writes nothing.

Defined results: a null text counts as empty; a text beyond the units of a call is refused (``ValueError``); equal texts
are sent as often as they occur; an empty table makes no call; other columns pass through.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXTS, UNITS = 32, 32_768
Provider = Callable[[list[str]], dict]


class BadReply(RuntimeError):
    pass


@dataclass(frozen=True)
class Space:
    """What vectors must share to be compared."""

    provider: str
    model: str
    revision: str
    dimension: int
    query_instruction: str = ""
    document_instruction: str = ""

    def key(self) -> str:
        return json.dumps([self.provider, self.model, self.revision, self.dimension, self.query_instruction, self.document_instruction])


def units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def filled(texts: list[str], most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """The calls that take ``texts`` in order, as start and end; each as full as its bounds allow."""
    start = size = 0
    for k, text in enumerate(texts):
        own = units(text)
        if own > UNITS:
            raise ValueError(f"a text of {own} units is beyond the {UNITS} of a call")
        if k > start and (k - start == most or size + own > UNITS):
            yield start, k
            start, size = k, 0
        size += own
    if len(texts) > start:
        yield start, len(texts)


def checked(reply: dict, space: Space, n: int) -> list[list[float]]:
    """The vectors of a reply to ``n`` texts, in the texts' order."""
    if not isinstance(reply, dict) or reply.get("model") != space.model:
        raise BadReply("model identity mismatch")
    if not isinstance(reply.get("data"), list):
        raise BadReply("missing embedding data")
    rows = sorted(reply["data"], key=lambda r: r["index"])
    if len(rows) != n:
        raise BadReply(f"embedding count mismatch: {len(rows)} for {n} texts")
    if [r["index"] for r in rows] != list(range(n)):
        raise BadReply("invalid embedding indices")
    for r in rows:
        vector = r["embedding"]
        if len(vector) != space.dimension:
            raise BadReply(f"a vector of dimension {len(vector)} in a space of {space.dimension}")
        if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector):
            raise BadReply("a vector that is not finite")
        if not any(vector):
            raise BadReply("a vector of zeros")
    return [[float(x) for x in r["embedding"]] for r in rows]


def instructed(space: Space, texts: list[str | None], purpose: str) -> list[str]:
    own = {"document": space.document_instruction, "query": space.query_instruction}[purpose]
    return [own + (t or "") for t in texts]


def called(provider: Provider, space: Space, texts: list[str | None], purpose: str = "document", most: int = TEXTS) -> list[list[float]]:
    """The vectors of ``texts``, by as many calls as they need."""
    sent = instructed(space, texts, purpose)
    return [v for a, b in filled(sent, most) for v in checked(provider(sent[a:b]), space, b - a)]


VECTOR = pa.list_(pa.float64())


def _mapped(rows: DataFrame, text: str, name: str, spark_type: T.DataType, arrow_type: pa.DataType, vectors: Callable[[list], list]) -> DataFrame:
    """``rows`` without ``text`` and with ``name``, whose values ``vectors`` makes of those of an Arrow batch."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(vectors(batch.column(len(kept)).to_pylist()), arrow_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*kept, name])

    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField(name, spark_type)])
    return rows.select(*kept, text).mapInArrow(run, schema)


def embedded(rows: DataFrame, space: Space, provider: Provider, text: str = "text", most: int = TEXTS) -> DataFrame:
    """``rows`` with ``vector`` in place of ``text``. Calls are filled from the rows of an Arrow batch in turn."""
    return _mapped(rows, text, "vector", T.ArrayType(T.DoubleType()), VECTOR, lambda texts: called(provider, space, texts, "document", most))


def embedded_batches(batches: DataFrame, space: Space, provider: Provider, texts: str = "texts") -> DataFrame:
    """``batches`` with ``vectors`` (one a text) in place of the array ``texts``; a row is one call, unless it is beyond a call's bounds."""
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    return _mapped(batches, texts, "vectors", kind, pa.list_(VECTOR), lambda rows: [called(provider, space, own or []) for own in rows])


class Lengths:
    """A provider without a model, for tests and as an example: how many tokens have each length (modulo 16), and a constant.

    It replies in reverse order, as a provider may.
    """

    def __init__(self, space: Space) -> None:
        self.model = space.model

    def __call__(self, texts: list[str]) -> dict:
        import regex

        data = []
        for k, text in enumerate(texts):
            vector = [0.0] * 16 + [1.0]
            for token in regex.findall(r"\p{Han}+|[\p{L}\p{N}_]+", text.lower()):
                vector[len(token) % 16] += 1
            data.append({"index": k, "embedding": vector})
        return {"model": self.model, "data": data[::-1]}
