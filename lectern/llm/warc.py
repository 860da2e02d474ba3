"""Operator 2: WARC archives written and read back, with segmented records put together again.

Writing. Of pages with equal payloads (SHA-256 and size) the one with the smallest page_id becomes a ``response`` record,
the others ``revisit`` records that name its identifier. A response's body is sent in chunked transfer framing; a block
of more than ``SEGMENT`` bytes is cut into a first record and ``continuation`` records, so that no record is larger, and
a file is filled up to ``FILE_BYTES``, whatever the records' sizes. A task joins the records of a file into one row; Spark's
text writer puts the compressed files into the folder: a record ends with two line ends, which is the writer's separator.

Reading. Files are parsed record by record; records that are whole are decoded at once, segments are grouped by their
origin's identifier, ordered by segment number, checked against the total length, and decoded.

Identifiers come from a row's content, so a task that runs again writes the same ones.

Defined results: null html is the empty payload; pages that share a page_id, or have none, get a record each; of rows that
are equal throughout, all are responses, or all revisits, under one identifier; a page whose page_id is null never is the
smallest, and without another one all of its group are responses; an empty table gives an empty folder; an extra column
is not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored, table

SEGMENT = 32_768
CHUNK = 8_192
#: Bytes of a file before it is compressed: a bound on what a writer and a reader hold.
FILE_BYTES = 32 << 20
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = line + 2 + size + 2
        if at > len(body):
            raise ValueError("a chunk ends beyond its record")
        out.append(body[line + 2 : line + 2 + size])


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records_of(identity: str, page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """``identity`` and ``refers_to`` are page_id:tag."""
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    common += [("WARC-Target-URI", " ".join(url.split()))] if url else []
    common += [("X-Page-Id", str(page_id))] if page_id is not None else []
    own = [("WARC-Record-ID", f"<urn:record:{identity}>")]
    http = [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:record:{refers_to}>")]
        return [record(more + own + common + http, b"HTTP/1.1 200 OK\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *own, *common, *http], block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([("WARC-Type", "response"), *own, *common, *http, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        ids = [("WARC-Record-ID", f"<urn:record:{identity}:{k}>"), ("WARC-Segment-Origin-ID", f"<urn:record:{identity}>"), ("WARC-Segment-Number", str(k))]
        out.append(record([("WARC-Type", "continuation"), *ids, *last, ("WARC-Date", "1970-01-01T00:00:00Z")], part))
    return out


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = archive.index(END, at)
        lines = archive[at:end].decode().split("\r\n")[1:]
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        start, size = end + 4, int(fields["content-length"])
        if archive[start + size : start + size + 4] != END:
            raise ValueError(f"a record's length is wrong at byte {at}")
        yield fields, archive[start : start + size]
        at = start + size + 4


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, file_bytes: int = FILE_BYTES) -> str:
    """pages: (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.xxhash64("page_id", "url", html).alias("tag"))
    keyed = own.select("page_id", "tag", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("size"))
    # smallest page_id of each payload; of several rows of that page_id the one with the smallest tag
    first = keyed.groupBy("sha", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "tag")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and not first.none")
    again = keyed.join(first, ["sha", "size"]).where((F.col("tag") != F.col("first.tag")) | ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    again = again.select(F.col("tag").alias("same_tag"), F.col("page_id").alias("same_id"), F.concat_ws(":", "first.page_id", "first.tag").alias("refers_to")).dropDuplicates(["same_tag", "same_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["file"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for tag, page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    for one in records_of(f"{page_id}:{tag}", page_id, url, html.encode(), refers_to, segment):
                        if held and size + len(one) > file_bytes:
                            yield file()
                            held, size = [], 0
                        held.append(one)
                        size += len(one) + len(END)
        if held:
            yield file()

    same = (F.col("tag") == F.col("same_tag")) & F.col("page_id").eqNullSafe(F.col("same_id"))
    rows = own.join(again, same, "left").select("tag", "page_id", "url", "html", "refers_to").mapInArrow(run, "file binary")
    written = rows.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    written.option("maxRecordsPerFile", 1).text(folder)
    return folder


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type, refers_to; payload and its size are null for revisits.

    The files are parsed once; without ``payloads`` they are checked and measured, but not kept.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    kept = "origin string, page_id long, record_type string, refers_to long, stated string, segment int, total long, block binary, payload binary, payload_bytes long"
    names = [x.split()[0] for x in kept.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def rows(archive: bytes) -> Iterator[tuple]:
        for f, block in parsed(archive):
            page = int(f["x-page-id"]) if "x-page-id" in f else None
            refers = int(f["warc-refers-to"].removeprefix("<urn:record:").split(":")[0]) if "warc-refers-to" in f else None
            total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
            segment = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
            stated = f["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in f else None
            payload = dechunked(block.split(END, 1)[1]) if segment is None and f["warc-type"] == "response" else None
            if payload is not None and digest(payload) != stated:
                raise ValueError("a payload does not have its record's digest")
            yield f.get("warc-segment-origin-id", f["warc-record-id"]), page, f["warc-type"], refers, stated, segment, total, block if segment else None, payload if payloads else None, None if payload is None else len(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                found = list(rows(gzip.decompress(archive.as_buffer())))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = sorted((p["segment"], p["block"]) for p in r["parts"])
                times = sum(number == 1 for number, _ in parts)  # rows that are equal throughout
                whole = parts[:: max(times, 1)]
                block = b"".join(b for _, b in whole)
                if [n for n, _ in parts] != [n for n in range(1, len(whole) + 1) for _ in range(times)] or len(block) != r["total"]:
                    raise ValueError(f"record {r['origin']} is not complete")
                payload = dechunked(block.split(END, 1)[1])
                if digest(payload) != r["stated"]:
                    raise ValueError("a payload does not have its record's digest")
                out += [(r["page_id"], payload if payloads else None, len(payload), r["stated"])] * times
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["page_id", "payload", "payload_bytes", "payload_digest"])

    every = stored(files.mapInArrow(run, kept), "warc-records")
    parts = every.where("segment is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("stated").alias("stated"), F.max("total").alias("total"), F.collect_list(F.struct("segment", "block")).alias("parts")
    )
    joined = parts.mapInArrow(assemble, "page_id long, payload binary, payload_bytes long, payload_digest string")
    whole = every.where("segment is null").select("page_id", "payload", "payload_bytes", F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    none = F.lit(None).cast("long")
    return whole.unionByName(joined.select("page_id", "payload", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), none.alias("refers_to")))


def resolved(records: DataFrame) -> DataFrame:
    """The records with ``payload_bytes``; a revisit has those of the response that it refers to."""
    narrow = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    own = narrow.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("referred_bytes"))
    return narrow.join(own, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "referred_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return resolved(read(spark, folder, payloads=False))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
