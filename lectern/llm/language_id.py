"""Operator 5: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and 1- to 3-grams are hashed into ``WIDTH`` features.
Document frequencies cover all training rows. The weights are trained by follow-the-regularised-leader with an
elastic net on a sample of at most about ``ROWS_A_LANGUAGE`` rows of each language (chosen by a hash of doc_id; a
documented bound), in one task; a fifth of the sample is kept back to fit the softmax temperature.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows with null doc_id or null lang are
never learnt from (their ``held_out`` is false); with no training rows everything is ``und``; repeated rows are
predicted each for itself; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, table

WIDTH = 1 << 15
ROWS_A_LANGUAGE = 1500
PASSES = 2
#: Characters of a text that are hashed together.
TOGETHER = 1 << 20
#: FTRL: learning rate, its smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
SCALE = 30.0

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed 1-, 2- and 3-grams of a text, in arrays; nothing for a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    letter = letters()[codes]
    if not letter.any():
        return
    keep = letter | np.r_[True, letter[:-1]]  # the first of a run of others stays, as a space
    codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    for i in range(0, len(codes), TOGETHER):
        one = codes[i : i + TOGETHER + 2]
        h = one * a
        first = h[: min(TOGETHER, len(codes) - i)]
        h2 = (h[:-1] ^ (one[1:] + np.uint32(77))) * b
        h3 = (h2[:-1] ^ (one[2:] + np.uint32(99))) * c
        for x, n in ((first, 1), (h2, 2), (h3, 3)):
            yield (x[: min(TOGETHER, max(0, len(codes) - i - n + 1))] ^ (x[: min(TOGETHER, max(0, len(codes) - i - n + 1))] >> np.uint32(15))) >> np.uint32(17)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each feature, over all rows of ``docs`` (text); and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language_id")
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = np.zeros(WIDTH, bool)
                for g in grams(text or ""):
                    seen[g] = True
                total += seen
                n += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found], pa.int64()), pa.array(np.r_[n, total[found]], pa.int64())], ["feature", "n"])

    # bounded by WIDTH
    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(WIDTH, np.int64)
    known = rows[rows["feature"] >= 0]
    counts[known["feature"].to_numpy()] = known["n"].to_numpy()
    return counts, int(rows.loc[rows["feature"] < 0, "n"].sum())


def train(sample: pd.DataFrame, idf: np.ndarray) -> dict | None:
    """Weights by FTRL on four fifths of (text, lang, part), the temperature on the rest."""
    classes = sorted(sample["lang"].unique())
    index = {c: i for i, c in enumerate(classes)}
    fit, kept = [], []
    for text, lang, part in sorted(zip(sample["text"], sample["lang"], sample["part"]), key=lambda r: (r[2], r[1])):
        counts = np.zeros(WIDTH, np.int64)
        for g in grams(text):
            counts += np.bincount(g, minlength=WIDTH)
        at = np.flatnonzero(counts)
        if len(at):
            x = SCALE * counts[at] / counts.sum() * idf[at]
            (kept if part % 5 == 0 else fit).append((at, x, index[lang]))
    if not fit:
        return None
    z, n, k = np.zeros((WIDTH + 1, len(classes))), np.zeros((WIDTH + 1, len(classes))), len(classes)

    def weights(at) -> np.ndarray:
        free = np.where(at == WIDTH, 0.0, 1.0)[:, None]  # the intercept is not penalised
        return np.where(np.abs(z[at]) <= L1 * free, 0.0, -(z[at] - np.sign(z[at]) * L1 * free) / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * free))

    for _ in range(PASSES):
        for at, x, y in fit:
            at, x = np.r_[at, WIDTH], np.r_[x, 1.0]
            w = weights(at)
            p = np.exp((s := x @ w) - s.max())
            g = np.outer(x, p / p.sum() - np.eye(k)[y])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(WIDTH + 1))
    logits = [(x @ w[at] + w[WIDTH], y) for at, x, y in kept or fit]

    def loss(t: float) -> float:
        return sum(np.log(np.exp((s - s.max()) / t).sum()) - (s[y] - s.max()) / t for s, y in logits)

    temperature = min(np.geomspace(0.2, 20, 120), key=loss)
    return {"classes": classes, "weights": (SCALE * w[:WIDTH] * idf[:, None]).astype(np.float32), "bias": w[WIDTH], "temperature": float(temperature)}


def fit(docs: DataFrame) -> dict | None:
    """Learn from the rows of (doc_id, text, lang) that are not held out."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    counts, rows = document_frequencies(known)
    if not rows:
        return None
    idf = np.log((1 + rows) / (1 + counts)) + 1
    share = {r["lang"]: min(1.0, ROWS_A_LANGUAGE / r["count"]) for r in known.groupBy("lang").count().collect()}
    shares = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 40)) / F.lit(1 << 40)
    sample = known.where(draw < shares[F.col("lang")]).select("text", "lang", F.xxhash64("doc_id", F.lit(9)).alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(train(pdf, idf))]})

    models = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def predict(docs: DataFrame, model: dict | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language_id")
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(place).to_pylist():
                total, n = 0.0, 0
                for g in grams(value or "") if model else ():
                    total = total + model["weights"][g].sum(0, dtype=np.float64)
                    n += len(g)
                if n:
                    s = (total / n + model["bias"]) / model["temperature"]
                    p = np.exp(s - s.max())
                    langs.append(model["classes"][int(p.argmax())])
                    scores.append(float(p.max() / p.sum()))
                else:
                    langs.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
