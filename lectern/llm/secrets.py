"""Operator 11: secrets by base patterns and by character Markov models.

Three base patterns (assign, access, hex) always count. Beside them every run of at least ``LEAST`` letters, digits and
``+ / _ -`` with a letter in it, that overlaps no base span, is a candidate; it is a secret of kind ``random`` when the
log-likelihood ratio of two character models, a character, reaches a threshold.

Models. Both are chains of second order over the alphabet, smoothed by those of first and no order. *random* is trained
on the different values in base spans, each also as its SHA-256 in base 64 and base 32, which stand for keys in alphabets
that the patterns don't know; *ordinary* on all runs of at least ``WORD`` characters outside base spans in the form of
words and identifiers (``in_words``: no letter after a digit, and a capital after a small letter in at most every eighth
place). Other runs have no label. Counts cover all documents; a task sends one row for each three characters that it
met, so what the driver holds is bounded by the alphabet's cube.

Threshold. A quarter of the values of either label (by their crc32) is not trained on. Of the scores from 0 up from which
on at least ``PRECISION`` of these held-out samples are labelled secrets, the threshold is the one with the best F measure,
of several the highest; of ordinary runs those that are candidates count. ``quality`` gives its precision and recall.

Spans are start and end in code points, end exclusive; an assign span is the whole match. Places are found in time linear in the text.

Defined results: null and empty texts have no span; repeated rows get a result each; without a labelled value, or where no
score has the precision, nothing is added; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LEAST, WORD = 16, 6
PRECISION = 0.99
#: Steps of a score that thresholds are looked for in.
STEP = 0.05
#: How many observations the model of the next lower order counts for.
WEIGHT = 4.0
#: Bytes of text taken together.
TOGETHER = 8 << 20
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIZE = len(ALPHABET) + 1  # 0: no character of the alphabet
# The contract's patterns. The letters of the first are in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: What a text must have for the patterns to be tried.
NEEDED = r"""[0-9a-f]{24}|AKIA[A-Z0-9]{16}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""

CODES = np.zeros(256, np.uint8)
CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, stop, value) of the base matches, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), k, m.end(), m[0]) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    return sorted(found)


def is_held_out(value: str) -> bool:
    return zlib.crc32(value.encode()) % 4 == 0


#: Classes of codes.
SMALL, CAPITAL, DIGIT = ((first, first + n - 1) for first, n in ((1, 26), (27, 26), (53, 10)))


def in_words(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of the runs ``start`` to ``stop`` have the form of words and identifiers."""
    of = lambda c, kind: (c >= kind[0]) & (c <= kind[1])
    one, two = codes[:-1], codes[1:]
    turns = [np.cumsum(np.r_[0, 0, x]) for x in (of(one, DIGIT) & (of(two, SMALL) | of(two, CAPITAL)), of(one, SMALL) & of(two, CAPITAL))]
    after_digit, capitals = (t[stop] - t[start + 1] for t in turns)
    return (after_digit == 0) & (8 * capitals <= stop - start)


def grams(codes: np.ndarray) -> np.ndarray:
    """For each place the number of its character and the two before it in its run."""
    one = np.r_[np.uint8(0), codes[:-1]]
    two = np.where(one > 0, np.r_[np.uint8(0), one[:-1]], 0)
    return (two.astype(np.int64) * SIZE + one) * SIZE + codes


def codes_of(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all values, a zero after each, and the number of the value that a place belongs to."""
    raw = "\n".join([*values, ""]).encode("ascii", "replace")
    return CODES[np.frombuffer(raw, np.uint8)], np.repeat(np.arange(len(values)), [len(v) + 1 for v in values])


def is_in_words(value: str) -> bool:
    codes, _ = codes_of([value])
    return bool(in_words(codes, np.array([0]), np.array([len(value)]))[0])


def renditions(value: str) -> list[str]:
    digest = hashlib.sha256(value.encode()).digest()
    return [value, base64.b64encode(digest).decode().rstrip("="), base64.b32encode(digest).decode().rstrip("=")]


SCANNED = "doc_id long, base array<struct<start:int,kind:int,stop:int,value:string>>, candidates array<struct<start:int,stop:int,value:string>>, is_document boolean, gram array<int>, n array<long>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its base spans and candidates; and one row a task: the counts of ordinary text that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))),
            ("candidates", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))),
            ("is_document", pa.bool_()), ("gram", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
        ])
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, side="right")))
                part, at = batch.slice(at, stop - at), stop
                base, candidates, found = scanned(pc.fill_null(part.column(1).cast(pa.large_string()), ""))
                total += found
                none = pa.nulls(part.num_rows)
                columns = [part.column(0), pa.array(base, schema.field(1).type), pa.array(candidates, schema.field(2).type), pa.array([True] * part.num_rows), none.cast(schema.field(4).type), none.cast(schema.field(5).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, False, met, total[met]), schema.types)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, SCANNED)


def scanned(texts: pa.Array) -> tuple[list, list, np.ndarray]:
    """Base spans and candidates of each text, and how often ordinary text has each three characters."""
    tried = np.array(pc.match_substring_regex(texts, NEEDED))
    raw = b"".join(f"{t}\n".encode() for t in texts.to_pylist())
    data = np.frombuffer(raw, np.uint8)
    begin = np.cumsum(np.r_[0, np.asarray(pc.binary_length(texts), np.int64) + 1])
    codes = CODES[data]
    edges = np.flatnonzero(np.diff(codes > 0, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    start, stop = start[stop - start >= WORD], stop[stop - start >= WORD]
    doc = np.searchsorted(begin, start, side="right") - 1
    # code points before a byte
    before = np.cumsum((data & 0xC0) != 0x80)
    point = lambda at, own: np.r_[0, before][at] - np.r_[0, before][begin[own]]
    first, last = point(start, doc), point(stop, doc)
    base: list[list] = [[] for _ in range(len(texts))]
    free = np.ones(len(start), bool)
    runs = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in np.flatnonzero(tried):
        base[i] = base_spans(texts[i].as_py())
        a, b = runs[i], runs[i + 1]
        if base[i] and b > a:
            # a run is free when no span that starts before its end reaches beyond its start
            reach = np.maximum.accumulate([0, *[s[2] for s in base[i]]])
            free[a:b] = reach[np.searchsorted([s[0] for s in base[i]], last[a:b])] <= first[a:b]
    start, stop, doc, first, last = (x[free] for x in (start, stop, doc, first, last))
    kept = in_words(codes, start, stop)
    kept[kept] = np.array([zlib.crc32(raw[s:e]) % 4 != 0 for s, e in zip(start[kept].tolist(), stop[kept].tolist())], bool)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start[kept], 1)
    np.add.at(inside, stop[kept], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    counts = np.bincount(grams(codes)[inside], minlength=SIZE**3)
    candidates: list[list] = [[] for _ in range(len(texts))]
    for k in np.flatnonzero(stop - start >= LEAST):
        value = raw[start[k] : stop[k]].decode()
        if not value.strip("0123456789+/_-"):
            continue
        candidates[doc[k]].append((int(first[k]), int(last[k]), value))
    keep = lambda rows, names: [[dict(zip(names, r)) for r in own] for own in rows]
    return keep(base, ("start", "kind", "stop", "value")), keep(candidates, ("start", "stop", "value")), counts


def log_chances(counts: np.ndarray) -> np.ndarray:
    """By the numbers of three characters, the log-probability of the last after the two before it."""
    cube = counts.reshape(SIZE, SIZE, SIZE).astype(float).copy()
    cube[:, :, 0] = 0
    square, line = cube.sum(0), cube.sum((0, 1))
    uniform = np.full(SIZE, 1 / (SIZE - 1))
    line = (line + WEIGHT * uniform) / (line.sum() + WEIGHT)
    square = (square + WEIGHT * line) / (square.sum(1, keepdims=True) + WEIGHT)
    cube = (cube + WEIGHT * square) / (cube.sum(2, keepdims=True) + WEIGHT)
    return np.log(cube).ravel()


def scores(values: list[str], ratio: np.ndarray) -> np.ndarray:
    """The mean log-likelihood ratio of the characters of each value, 0 for an empty one."""
    if not values:
        return np.zeros(0)
    codes, own = codes_of(values)
    real = codes > 0
    return np.bincount(own[real], ratio[grams(codes)[real]], minlength=len(values)) / np.maximum(np.bincount(own[real], minlength=len(values)), 1)


def secret_values(rows: DataFrame) -> DataFrame:
    """The different values in base spans that are long enough to be candidates."""
    return rows.where("is_document").select(F.explode("base.value").alias("value")).where(F.length("value") >= LEAST).distinct()


def fit(rows: DataFrame) -> np.ndarray | None:
    """The log-likelihood ratio by three characters, from scanned ``rows``; None without a labelled value."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            values = [r for v in batch.column(0).to_pylist() if not is_held_out(v) for r in renditions(v)]
            if values:
                codes, _ = codes_of(values)
                total += np.bincount(grams(codes)[codes > 0], minlength=SIZE**3)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["gram", "n"])

    def summed(counts: DataFrame) -> np.ndarray:
        found = counts.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # the alphabet's cube at most
        out = np.zeros(SIZE**3, np.int64)
        out[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        return out

    random = summed(secret_values(rows).mapInArrow(count, "gram int, n long"))
    if not random.any():
        return None
    ordinary = rows.where("not is_document").select(F.explode(F.arrays_zip("gram", "n")).alias("x")).select("x.gram", "x.n")
    return log_chances(random) - log_chances(summed(ordinary))


def held_out(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(step, good, n): of the held-out samples by score, how many are labelled secrets and how many there are."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)
    secret = secret_values(rows).withColumn("good", F.lit(True))
    other = rows.where("is_document").select(F.explode("candidates.value").alias("value")).distinct().withColumn("good", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(v, g) for v, g in zip(*(c.to_pylist() for c in batch.columns)) if is_held_out(v) and (g or is_in_words(v))]
            values = [(r, g) for v, g in held for r in (renditions(v) if g else [v])]
            steps = np.floor(scores([v for v, _ in values], shared.value) / STEP)
            yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array([int(g) for _, g in values], pa.int64())], ["step", "good"])

    return secret.unionByName(other).mapInArrow(run, "step long, good long").groupBy("step").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))


def quality(rows: DataFrame, ratio: np.ndarray) -> tuple[float, float, float] | None:
    """The threshold and its precision and recall on the held-out samples; a score has some hundred steps, bounded by the smoothing."""
    steps = sorted(((r["step"], r["good"], r["n"]) for r in held_out(rows, ratio).collect() if r["n"]), reverse=True)
    every, good, n, best = sum(g for _, g, _ in steps), 0, 0, None
    for step, g, k in steps:
        good, n = good + g, n + k
        if step >= 0 and good and good >= PRECISION * n and (best is None or good / (n + every) > best[0]):
            best = good / (n + every), step * STEP, good / n, good / every
    return best and best[1:]


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, values): all spans by start, then kind, as (start, kind, stop), and what they hold."""
    rows = stored(scan(docs), "secrets")
    ratio = fit(rows)
    found = None if ratio is None else quality(rows, ratio)
    least = found and found[0]
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, candidates = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            flat = [(i, c) for i, own in enumerate(candidates) for c in own]
            every = [[(b["start"], b["kind"], b["stop"], b["value"]) for b in own] for own in base]
            if least is not None:
                for (i, c), s in zip(flat, scores([c["value"] for _, c in flat], shared.value)):
                    if s >= least:
                        every[i].append((c["start"], KINDS.index("random"), c["stop"], c["value"]))
            spans = [[dict(zip(("start", "kind", "stop", "value"), x)) for x in sorted(own)] for own in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.schema.field(1).type)], ["doc_id", "spans"])

    return rows.where("is_document").select("doc_id", "base", "candidates").mapInArrow(run, "doc_id long, spans array<struct<start:int,kind:int,stop:int,value:string>>")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    # a second parameter of a filter's function is the place in the array, so the kind is not one
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
