"""Overlapping retrieval chunks that cover a text without loss.

A chunk's end decides where the next one starts, so texts are cut one after another inside an Arrow batch; texts of
at most ``LONGEST`` code units need no cut and stay in the JVM.

Defined results: null and empty texts have no chunk; offsets are UTF-16 code units and never split a surrogate pair;
repeated rows give their chunks again; a text of more than ``MOST`` chunks is refused (``TooLong``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import utf16_length

# Sizes in code units, chunks of a text, and what may end a chunk, best first.
LONGEST, EARLIEST, TARGET, OVERLAP, MOST = 1200, 600, 800, 100, 5000
SPACE = r"[\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BOUNDARIES = [re.compile(rf"\n{SPACE}*\n"), re.compile(r"\n"), re.compile(rf"[。！？]|[.!?](?:{SPACE}+|\Z)")]

PARTS = "pos int, start int, stop int, text string"


def code_units(text: str) -> str:
    """One character for each UTF-16 code unit."""
    if text.isascii() or max(text) <= "\uffff":
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(map(chr, memoryview(raw).cast("H")))


def spans(units: str) -> Iterator[tuple[int, int]]:
    def whole(at: int) -> int:
        inside = 0 < at < len(units) and "\ud800" <= units[at - 1] <= "\udbff" and "\udc00" <= units[at] <= "\udfff"
        return at - inside

    start = 0
    while len(units) - start > LONGEST:
        goal = start + TARGET
        for boundary in BOUNDARIES:
            ends = [m.end() for m in boundary.finditer(units, start + EARLIEST, start + LONGEST)]
            if ends:
                goal = min(ends, key=lambda e: (abs(e - start - TARGET), e))
                break
        stop = whole(goal)
        yield start, stop
        start = whole(stop - OVERLAP)
    if units:
        yield start, len(units)


class TooLong(ValueError):
    """A text has more chunks than may be indexed."""


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["document_id", "pos", "start", "stop", "text"]
    for batch in batches:
        types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for i in range(0, batch.num_rows, 100):
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.slice(i, 100).columns)):
                units = code_units(text)
                own = [*spans(units)]
                if len(own) > MOST:
                    raise TooLong(f"document {key} has {len(own)} chunks; at most {MOST} are allowed")
                rows += [(key, i, a, b, units[a:b].encode("utf-16-le", "surrogatepass").decode("utf-16-le")) for i, (a, b) in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def retrieval_chunks(documents: DataFrame) -> DataFrame:
    """(document_id, pos, start, stop, text) from (document_id, text), ids of any type; no shuffle."""
    own = documents.select("document_id", "text").where("text <> ''")
    schema = f"document_id {documents.schema['document_id'].dataType.simpleString()}, {PARTS}"
    size = utf16_length(F.col("text")).cast("int")
    short = own.where(size <= LONGEST).select("document_id", F.lit(0).alias("pos"), F.lit(0).alias("start"), size.alias("stop"), "text")
    return short.unionByName(own.where(size > LONGEST).mapInArrow(_cut, schema))
